"""Language-model scores by prediction by partial matching over bytes.

Training counts every (context of ORDER bytes, next byte) of the training texts; shorter contexts follow from the sums.
The counts become a context trie with escape estimates (method C: as many escapes as distinct next bytes) and, for each
context, what is left of its shorter context once its own next bytes are excluded. The trie lies in hash tables in the
shared folder, built in shards by tasks and mapped into memory by the scoring tasks, so no worker holds it. A text's
score is the log10 probability of its bytes and its end. Keys hold a context with its nearest byte first, so that the
contexts that share a suffix are one range.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table, staged

ORDER = 5
#: The byte that pads contexts at the start of a text and stands for its end; UTF-8 has none.
END = 0xFF
#: Log10 tables come in so many shards, built by a task each.
SHARDS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Keys that a training task gathers before it passes them on, and text bytes that are scored at once.
GATHERED, AT_ONCE = 3_000_000, 2_000_000
REMEMBERED = 300_000
#: Bits of a word count's lower half.
COUNT_BITS = 20
GRAM, WORD = 0, 1
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def joined_counts(halves: np.ndarray) -> np.ndarray:
    return halves[:, 0].astype(np.float64) * (1 << COUNT_BITS) + halves[:, 1]


def keys_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The key (context, nearest byte first, then the next byte) of every byte and end, and where each text starts."""
    pad = bytes([END]) * order
    a = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), np.uint8).astype(U)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    # where the symbols lie in a: after the pads
    at = np.arange(sizes.sum(), dtype=np.int64) + np.repeat(order * (np.arange(len(texts)) + 1), sizes)
    key = np.zeros(len(a), U)
    for back in range(1, order + 1):
        key[back:] |= a[:-back] << U(8 * (order + 1 - back))
    key |= a
    return key[at], starts


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def training_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): counts of keys (GRAM) and of words by their hash (WORD) of the column text, lower-cased, summed over all."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if len(held) == 1:
                return held[0]
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 500_000):
                k = keys[i : i + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[i : i + 500_000].astype(np.int64))], names=["kind", "key", "n"])

        def pass_words() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter(map(word_hash, words), U, len(words))
            yield from rows(WORD, keys, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for batch in batches:
            for part in _parts([lowered(x) for x in batch.column(0).to_pylist()]):
                for t in part:
                    words.update(t.split())
                keys = np.sort(keys_of(part, order)[0])
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                size += len(first)
                if len(held) > 5 or size > GATHERED:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > GATHERED:
                        yield from rows(GRAM, *held.pop())
                        size = 0
                if len(words) > REMEMBERED:
                    yield from pass_words()
        if held:
            yield from rows(GRAM, *merged())
        yield from pass_words()

    found = texts.select("text").mapInArrow(gather, "kind byte, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of about AT_ONCE bytes together; a longer text goes alone."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def tag(level: int) -> np.uint64:
    return U((level + 1) << 56)


class Dense:
    """Orders 1 and 0 in arrays: at most 65,536 counts, whatever the corpus."""

    def __init__(self, pairs: np.ndarray) -> None:
        """pairs: 256 x 256 counts of (context byte, next byte)."""
        self.n1 = pairs.astype(np.float64)
        self.n0 = self.n1.sum(axis=0)
        with np.errstate(divide="ignore"):
            self.log1, self.log0 = np.log10(self.n1), np.log10(self.n0)
            total, kinds = self.n1.sum(axis=1), (self.n1 > 0).sum(axis=1)
            self.seen1 = total > 0
            self.a1, self.t1 = np.log10(total + kinds), np.log10(kinds)
            rest = self.n0.sum() - ((self.n1 > 0) * self.n0).sum(axis=1)
            left = (self.n0 > 0).sum() - kinds
            self.l1, self.lt1 = _left(rest, left)
            kinds0 = (self.n0 > 0).sum()
            self.seen0 = bool(kinds0)
            self.a0, self.t0 = np.log10(self.n0.sum() + kinds0), np.log10(kinds0)
            self.uniform = -np.log10(256 - kinds0) if kinds0 < 256 else 0.0


def _left(rest: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of what is left to share after exclusion, and of the escapes in it; if nothing is left the escape is certain."""
    none = kinds <= 0
    both = np.where(none, 1.0, rest + kinds)
    return np.log10(both), np.log10(np.where(none, 1.0, kinds))


def trie_entries(keys: np.ndarray, n: np.ndarray, dense: Dense, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair keys and log10 values, context keys and (log10(N+T), log10 T, log10 left, log10 escapes left).

    keys: all that share their two nearest context bytes, or several such ranges. The value of a pair of the highest
    order is its log10 probability, of others log10 of its count.
    """
    pair_keys, pair_values, ctx_keys, ctx_values = [], [], [], []
    levels = {}
    k, c = keys, n
    for level in range(order, 1, -1):
        if level < order:
            # drop the farthest context byte, which is just above the symbol
            k, c = _sums((k >> U(16)) << U(8) | (k & U(255)), c)
        ctx = k >> U(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(k) else np.zeros(0, np.int64)
        total = np.add.reduceat(c, first) if len(k) else c
        kinds = np.diff(np.append(first, len(k)))
        levels[level] = (k, c, ctx[first], total, kinds, first)
    for level in range(order, 1, -1):
        k, c, ctx, total, kinds, first = levels[level]
        if not len(k):
            continue
        a = np.log10(total + kinds)
        logs = np.log10(c)
        if level == order:
            logs = logs - np.repeat(a, kinds)
        symbol = k & U(255)
        if level > 2:
            k2, c2, ctx2, total2, kinds2, _ = levels[level - 1]
            of = np.searchsorted(k2, (k >> U(16)) << U(8) | symbol)
            shorter = c2[of]
            up = np.searchsorted(ctx2, ctx >> U(8))
            rest_total, rest_kinds = total2[up], kinds2[up]
        else:
            nearest = (k >> U(16)).astype(np.int64)
            shorter = dense.n1[nearest, symbol.astype(np.int64)]
            up = (ctx >> U(8)).astype(np.int64)
            rest_total, rest_kinds = dense.n1.sum(axis=1)[up], (dense.n1 > 0).sum(axis=1)[up]
        left, escapes = _left(rest_total - np.add.reduceat(shorter, first), rest_kinds - kinds)
        pair_keys.append(tag(level) | k)
        pair_values.append(logs)
        ctx_keys.append(tag(level) | ctx)
        ctx_values.append(np.stack([a, np.log10(kinds), left, escapes], axis=1))
    if not pair_keys:
        return np.zeros(0, U), np.zeros(0), np.zeros(0, U), np.zeros((0, 4))
    return np.concatenate(pair_keys), np.concatenate(pair_values), np.concatenate(ctx_keys), np.concatenate(ctx_values)


class Table:
    """An open-addressing hash table in mapped files: keys and rows of float64 or float32 values. Zero is no key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, shards: int = SHARDS) -> None:
        self.keys, self.values, self.shards = keys, values, shards
        self.capacity = len(keys) // shards if shards else 0

    @staticmethod
    def place(keys: np.ndarray, shards: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        h = keys * MIX
        h ^= h >> U(32)
        h = h * MIX
        bits = U(64 - int(shards).bit_length() + 1)
        return (h >> bits).astype(np.int64), ((h >> U(8)) & U(capacity - 1)).astype(np.int64)

    @classmethod
    def shard(cls, keys: np.ndarray, values: np.ndarray, shards: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of one shard."""
        table, out = np.zeros(capacity, U), np.zeros((capacity, values.shape[1]), np.float32)
        _, at = cls.place(keys, shards, capacity)
        todo = np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = table[slot] == 0
            _, winners = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[winners]
            table[slot[chosen]] = keys[todo[chosen]]
            out[slot[chosen]] = values[todo[chosen]]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo = todo[rest]
            at[todo] = (at[todo] + 1) & (capacity - 1)
        return table, out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers in values; -1 where there is none."""
        found = np.full(len(keys), -1, np.int64)
        if not self.capacity or not len(keys):
            return found
        part, at = self.place(keys, self.shards, self.capacity)
        base = part * self.capacity
        slot = base + at
        there = self.keys[slot]
        hit = there == keys
        found[hit] = slot[hit]
        todo = np.flatnonzero(~hit & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.capacity - 1)
            slot = base[todo] + at[todo]
            there = self.keys[slot]
            hit = there == keys[todo]
            found[todo[hit]] = slot[hit]
            todo = todo[~hit & (there != 0)]
        return found


def _local(path: str) -> str | None:
    return path.removeprefix("file://") if path.startswith(("file:", "/")) else None


def write_table(entries: DataFrame, width: int, name: str, shards: int = SHARDS) -> str:
    """Builds a Table from (key long, v array<float> or v0.. floats) in a folder of the shared folder, and returns it.

    Tasks build the shards; a last step strings their files together, so that one file can be mapped.
    """
    spark = entries.sparkSession
    folder = new_path(spark, name)
    values = [f"v{i}" for i in range(width)]

    def shard_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            yield df.assign(shard=Table.place(df["key"].to_numpy().view(U), shards, 2)[0].astype(np.int32))

    fields = ", ".join(f"{v} float" for v in values)
    rows = staged(entries.select("key", *values).mapInPandas(shard_of, f"key long, {fields}, shard int"), name + "-rows")
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    capacity = 1 << max(1, int(2 * most - 1).bit_length()) if most else 0
    if capacity:

        def build(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            from pyspark import TaskContext

            from .warc import _filesystem

            files, root = _filesystem(folder)
            files.create_dir(root, recursive=True)
            table, out = Table.shard(df["key"].to_numpy().view(U), df[values].to_numpy(np.float32), shards, capacity)
            stem = f"{root}/shard-{int(key[0]):04d}-{TaskContext.get().taskAttemptId()}"
            for end, data in (("keys", table), ("values", out)):
                with files.open_output_stream(f"{stem}.{end}", compression=None) as f:
                    f.write(data.tobytes())
            return pd.DataFrame({"shard": [int(key[0])], "stem": [stem]})

        stems = dict(map(tuple, rows.groupBy("shard").applyInPandas(build, "shard int, stem string").collect()))
        _string(folder, stems, shards, capacity, width)
    return folder if capacity else ""


def _string(folder: str, stems: dict[int, str], shards: int, capacity: int, width: int) -> None:
    from .warc import _filesystem

    files, root = _filesystem(folder)
    for end, size in (("keys", 8), ("values", 4 * width)):
        with files.open_output_stream(f"{root}/{end}", compression=None) as out:
            for i in range(shards):
                if i not in stems:
                    for _ in range(capacity // 2):
                        out.write(bytes(2 * size))
                    continue
                with files.open_input_stream(f"{stems[i]}.{end}", compression=None) as f:
                    while data := f.read(1 << 22):
                        out.write(data)
                files.delete_file(f"{stems[i]}.{end}")


def open_table(folder: str, width: int, shards: int = SHARDS) -> Table:
    """Maps a table of a local or mounted folder; one elsewhere is read."""
    if not folder:
        return Table(np.zeros(0, U), np.zeros((0, width), np.float32), shards)
    local = _local(folder)
    if local and os.path.exists(f"{local}/keys"):
        return Table(np.memmap(f"{local}/keys", U, "r"), np.memmap(f"{local}/values", np.float32, "r").reshape(-1, width), shards)
    from .warc import _filesystem

    files, root = _filesystem(folder)
    arrays = []
    for end, kind in (("keys", U), ("values", np.float32)):
        with files.open_input_file(f"{root}/{end}") as f:
            arrays.append(np.frombuffer(f.read(), kind))
    return Table(arrays[0], arrays[1].reshape(-1, width), shards)


class Model:
    """A trained model: folders of its tables and the small arrays; opened once a worker process."""

    def __init__(self, pairs: str, contexts: str, words: str, dense: Dense, tokens: int, vocabulary: int, texts: int, order: int) -> None:
        self.pairs, self.contexts, self.words, self.dense = pairs, contexts, words, dense
        self.tokens, self.vocabulary, self.texts, self.order = tokens, vocabulary, texts, order
        self._open: Any = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def open(self) -> tuple[Table, Table, Table]:
        if self._open is None:
            self._open = (open_table(self.pairs, 1), open_table(self.contexts, 4), open_table(self.words, 2))
        return self._open

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol in its context."""
        pairs, contexts, _ = self.open()
        dense, out = self.dense, np.zeros(len(keys))
        row = pairs.find(tag(self.order) | keys)
        hit = row >= 0
        out[hit] = pairs.values[row[hit], 0]
        todo = np.flatnonzero(~hit)
        if not len(todo):
            return out
        k = keys[todo]
        acc = np.zeros(len(todo))
        # left, escapes: what the context escaped from leaves of the next one; below: whether one was escaped from
        left, escapes, below = np.zeros(len(todo)), np.zeros(len(todo)), np.zeros(len(todo), bool)
        live = np.arange(len(todo))
        for level in range(self.order, 1, -1):
            if level < self.order:
                k = (k >> U(16)) << U(8) | (k & U(255))
                row = pairs.find(tag(level) | k)
            else:
                row = np.full(len(k), -1)
            ctx = contexts.find(tag(level) | k >> U(8))
            v = contexts.values[np.maximum(ctx, 0)].astype(np.float64) if contexts.capacity else np.zeros((len(k), 4))
            hit = row >= 0
            base = np.where(below[live], left[live], v[:, 0])
            if hit.any():
                acc[live[hit]] += pairs.values[row[hit], 0] - base[hit]
            seen = ~hit & (ctx >= 0)
            acc[live[seen]] += np.where(below[live[seen]], escapes[live[seen]], v[seen, 1]) - base[seen]
            left[live[seen]], escapes[live[seen]], below[live[seen]] = v[seen, 2], v[seen, 3], True
            live, k = live[~hit], k[~hit]
        nearest, symbol = (k >> U(16)).astype(np.int64) & 255, (k & U(255)).astype(np.int64)
        hit = dense.n1[nearest, symbol] > 0
        base = np.where(below[live], left[live], dense.a1[nearest])
        acc[live[hit]] += dense.log1[nearest[hit], symbol[hit]] - base[hit]
        seen = ~hit & dense.seen1[nearest]
        acc[live[seen]] += np.where(below[live[seen]], escapes[live[seen]], dense.t1[nearest[seen]]) - base[seen]
        left[live[seen]], escapes[live[seen]], below[live[seen]] = dense.l1[nearest[seen]], dense.lt1[nearest[seen]], True
        live, symbol = live[~hit], symbol[~hit]
        hit = dense.n0[symbol] > 0
        base = np.where(below[live], left[live], dense.a0)
        acc[live[hit]] += dense.log0[symbol[hit]] - base[hit]
        rest = live[~hit]
        if dense.seen0:
            acc[rest] += np.where(below[rest], escapes[rest], dense.t0) - base[~hit]
        acc[rest] += dense.uniform if dense.seen0 else -np.log10(256)
        out[todo] = acc
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each lower-cased text and its end."""
        out = []
        for part in _parts(texts):
            keys, starts = keys_of(part, self.order)
            out.append(np.add.reduceat(self.log10(keys), starts))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """A model of the column text of all rows; null counts as empty."""
    counts = staged(training_counts(texts, order), "counts")
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n")
    words = counts.filter(F.col("kind") == WORD)
    nearest = F.shiftrightunsigned("key", 8 * order).bitwiseAND(F.lit(255))
    pairs = np.zeros((256, 256))
    # at most 65,536 rows
    for a, b, n in grams.groupBy(nearest.alias("a"), F.col("key").bitwiseAND(F.lit(255)).alias("b")).agg(F.sum("n").alias("n")).collect():
        pairs[int(a), int(b)] = n
    dense = Dense(pairs)
    total, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = int(pairs[:, END].sum())

    def entries(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All of a partition at once: ranges of two context bytes are whole in it."""
        held = [(df["key"].to_numpy(), df["n"].to_numpy()) for df in it]
        keys = np.concatenate([k for k, _ in held]).view(U) if held else np.zeros(0, U)
        n = np.concatenate([x for _, x in held]).astype(np.float64) if held else np.zeros(0)
        by = np.argsort(keys)
        pk, pv, ck, cv = trie_entries(keys[by], n[by], dense, order)
        for i in range(0, len(pk), 200_000):
            k = pk[i : i + 200_000]
            yield pd.DataFrame({"key": k.view(np.int64), "v0": pv[i : i + 200_000].astype(np.float32), "v1": np.float32(0), "v2": np.float32(0), "v3": np.float32(0), "pair": True})
        for i in range(0, len(ck), 200_000):
            v = cv[i : i + 200_000].astype(np.float32)
            yield pd.DataFrame({"key": ck[i : i + 200_000].view(np.int64), "v0": v[:, 0], "v1": v[:, 1], "v2": v[:, 2], "v3": v[:, 3], "pair": False})

    ranges = F.shiftrightunsigned("key", 8 * (order - 1))
    trie = staged(grams.withColumn("r", ranges).repartition("r").select("key", "n").mapInPandas(entries, "key long, v0 float, v1 float, v2 float, v3 float, pair boolean"), "trie")
    return Model(
        write_table(trie.filter("pair"), 1, "pairs"),
        write_table(trie.filter("not pair"), 4, "contexts"),
        # counts in two halves, as single floats are exact up to 2^24 only
        write_table(words.select("key", F.shiftright("n", COUNT_BITS).cast("float").alias("v0"), F.col("n").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("float").alias("v1")), 2, "words"),
        dense, int(total) + n_texts, int(vocabulary) + (n_texts > 0), n_texts, order,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row; tokens are the words and one end.

    Null text counts as empty: its one token is the end. Repeated rows score alike; other columns aren't read. An empty
    training set scores all bytes and tokens alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.open()[2]
        log = np.log10(model.tokens + 0.5 * (model.vocabulary + 1))
        unknown = float(np.log10(0.5) - log)
        end = float(np.log10(model.texts + 0.5) - log)
        memory: dict[bytes, float] = {}
        for batch in batches:
            texts = [lowered(x) for x in batch.column(1).to_pylist()]
            scores, base, n, known = [], [], [], []
            for part in _parts(texts):
                scores.append(model.score(part))
                split = [t.split() for t in part]
                if len(memory) > REMEMBERED:
                    memory.clear()
                new = list(set().union(*split) - memory.keys())
                rows = table.find(np.fromiter(map(word_hash, new), U, len(new)))
                counts = np.where(rows >= 0, joined_counts(table.values[np.maximum(rows, 0)]), 0) if table.capacity else np.zeros(len(new))
                memory.update(zip(new, np.where(counts > 0, np.log10(counts + 0.5) - log, unknown).tolist()))
                for words in split:
                    logs = list(map(memory.__getitem__, words))
                    base.append(sum(logs) + end)
                    n.append(len(words) + 1)
                    known.append(len(words) - logs.count(unknown) + (model.texts > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Any) -> Any:
    """Whether crc32 of doc_id as text leaves 1 when divided by 5; null is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of those that aren't held_out(); odd rows as there. Words are known by 64-bit hashes."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
