"""Byte-level BPE encoding and decoding by tree concatenation.

Text is cut where white space follows other characters: there every pre-token ends, so the parts encode by themselves
and short ones are remembered. Long unsplit text (a pre-token of more than LEAF bytes) is cut into halves down to leaves
that are encoded in parallel, and neighbours are joined pairwise: a window around each join is encoded anew and grows
until its first token and its last token are those that stood there before. A token sequence is the encoding of its text
if each neighbouring pair is the encoding of its own text, so the joined sequence then equals the direct encoding.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

#: Bytes of a leaf of the tree, and entries of a worker's memory of parts before it starts anew.
LEAF, REMEMBERED = 512, 400_000


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in plain}
    return found | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit numbers")


class Unsplit(Exception):
    """A part that can't be encoded by itself."""


class ByteBpe:
    """Encodes as the tokenizers library does with the file at path, without special tokens added."""

    def __init__(self, path: str, leaf: int = LEAF, remembered: int = REMEMBERED) -> None:
        import tiktoken
        import tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model, chars = spec["model"], byte_chars()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {bytes(chars[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        self.leaf = leaf
        self.special = special
        self.table = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for k, v in [*vocab.items(), *((k.encode(), v) for k, v in special.items())]:
            self.table[v] = k
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        # ranks stand for merges only if ids follow the order of the merges
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids) or not all(len(x) == 1 for x in self.table[:256]) or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens=special)
        self.bare = tokenizers.Tokenizer(tokenizers.models.BPE(vocab={k: v for k, v in model["vocab"].items()}, merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]))
        self.chars, self.letters = chars, {b: c for c, b in chars.items()}
        self.split = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        encode, as_bytes, ordinary = self.part, self._bytes, self.core._core_bpe.encode_ordinary

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                if not part or part[0].isspace() or part[-1].isspace():
                    raise Unsplit
                if len(self) >= remembered:
                    self.clear()
                if "<" in part or len(part) > 64:
                    return as_bytes(encode(" " + part))
                self[part] = found = as_bytes(ordinary(" " + part))
                return found

        self.parts = Parts()

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Unsplit
            return self._bytes(self.part(first)) + b"".join(map(self.parts.__getitem__, rest))
        except Unsplit:
            return self._bytes(self.part(text))

    def part(self, text: str) -> list[int]:
        """Ids of text that may hold white space anywhere."""
        if len(text) <= self.leaf:
            return self.core.encode(text, allowed_special="all")
        ids: list[int] = []
        for piece in self._specials(text):
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            tokens = [token for token, _ in self.split(piece)]
            if max(map(len, tokens)) <= self.leaf:
                ids += self.core.encode_ordinary(piece)
                continue
            for token in tokens:
                data = bytes(map(self.chars.__getitem__, token))
                ids += self.tree(data) if len(data) > self.leaf else self.core._core_bpe.encode_single_piece(data)
        return ids

    def _specials(self, text: str) -> list[str]:
        import re

        return [x for x in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if x]

    def tree(self, data: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        cuts = self._halves(0, len(data))
        leaves = ["".join(map(self.letters.__getitem__, data[a:b])) for a, b in cuts]
        level = [x.ids for x in self.bare.encode_batch_fast(leaves, add_special_tokens=False)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _halves(self, a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= self.leaf:
            return [(a, b)]
        return self._halves(a, (a + b) // 2) + self._halves((a + b) // 2, b)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts together, from those of each."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            window = self.core._core_bpe.encode_single_piece(b"".join(self.table[x] for x in left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + list(window) + right[j:]
            k *= 2

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer a worker process."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) or, with ids False, digests of ids and of the decoded text instead of them.

    Whole texts; null counts as empty and has no ids. Rows keep their number, repeated ones too; other columns aren't read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = tokenizer(path)
        decimal = [str(i).encode() for i in range(len(bpe.table))]
        for batch in batches:
            out: list[tuple] = []
            keys, texts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows):
                raw = bpe.encode(texts[i].as_py() or "")
                numbers = np.frombuffer(raw, dtype="<u4")
                if ids:
                    out.append((numbers.astype(np.int32),))
                    continue
                listed = numbers.tolist()
                joined = b",".join(map(decimal.__getitem__, listed))
                out.append((len(listed), hashlib.sha256(joined).hexdigest(), hashlib.sha256(bpe.decode(listed).encode()).hexdigest()))
            cols = list(zip(*out)) if out else [()] * (1 if ids else 3)
            types = [pa.list_(pa.int32())] if ids else [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(list(c), t) for c, t in zip(cols, types))], names=["doc_id", *(["ids"] if ids else ["n_tokens", "ids_sha256", "decoded_sha256"])])

    schema = "doc_id long, ids array<int>" if ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(encoded, schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read_table(spark, sf_dir, "documents"), default_path(), ids=False)
