"""Archives with damage, clashing names, texts with many secrets, and the registered queries' digests on a small folder."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from murmuration.llm import bpe, packing, registry, secrets, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def one_archive(spark, tmp_path_factory):
    rng = random.Random(1)
    pages = [(2**53 + i, f"http://h/{i}", "".join(rng.choice("abcdef <>") for _ in range(400))) for i in range(12)]
    (path, size), *_ = warc.archive(spark.createDataFrame(pages, PAGES).coalesce(1), f"file://{tmp_path_factory.mktemp('w')}/a")
    return path.removeprefix("file://"), size


def read(spark, data, tmp_path, split, damaged="raise"):
    path = tmp_path / f"{len(data)}-{split}-{hashlib.md5(data).hexdigest()}"
    path.write_bytes(data)
    return warc.read_warc(spark, [(f"file://{path}", len(data))], split_bytes=split, damaged=damaged)


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_damage_raises_or_skips(spark, one_archive, tmp_path, split):
    whole = open(one_archive[0], "rb").read()
    starts = [m.start() for m in re.finditer(re.escape(warc.MAGIC), whole)]
    assert read(spark, whole, tmp_path, split).count() == len(starts) == 12
    hurt = bytearray(whole)
    hurt[starts[5] + 60] ^= 0xFF
    no_header = bytearray(whole)
    no_header[starts[5]] = 0
    for data, left in ((bytes(hurt), 11), (bytes(no_header), 11), (whole[:-40], 11), (b"junk" + whole, 12), (whole + b"junk", 12)):
        with pytest.raises(Exception, match="[Dd]amaged|no record starts|archive ends"):
            read(spark, data, tmp_path, split).collect()
        assert read(spark, data, tmp_path, split, "skip").count() == left


def test_archive_of_odd_rows(spark, tmp_path):
    page = "x" * 200
    rows = [(None, "http://n/", page), (5, "http://a/", page), (5, "http://a/", page), (9, None, page), (None, None, None)]
    found = warc.read_warc(spark, warc.archive(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in found) == [("5", "response", "None"), ("5", "response", "None"), ("9", "revisit", "5"), ("None", "response", "None"), ("None", "revisit", "5")]


def test_packing_with_clashing_names(spark):
    rows = [(2**53 + 1 if i else None, i, 5 + i % 3, "a", "b", 1, 2) for i in range(30)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string, sequence_id string, part int, at int")
    found = packing.pack(pieces, 16)
    assert found.columns == ["doc_id", "piece", "length", "part", "at", "sequence_id", "offset"]
    assert sorted((r.piece, str(r.doc_id)) for r in found.collect()) == sorted((r[1], str(r[0])) for r in rows)


def spans_by_hand(text):
    """(start, kind, end) of the base rules."""
    rules = [(r'(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', 1, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)]
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(rules) for m in re.finditer(p, text) if len(m.group(g)) >= n)


def test_texts_with_many_secrets_and_clashing_names(spark):
    rng = random.Random(7)
    parts = ["token=abcdefghijkl", "AKIA" + "A" * 16, "0123456789abcdef", "plain é", "\n", "password: x", "API_KEY='0123456789abcdef0'", "中"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 5, 40, 900)] + [None]
    rows = spark.createDataFrame([(i, t, 1, True, "m") for i, t in enumerate(texts)], "doc_id long, text string, secret_spans int, may_assign boolean, may_doc_id string")
    found = secrets.scan(rows)
    assert found.columns == [*rows.columns, "secret_spans_"]
    base = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans_ if s.kind < 3] for r in found.collect()}
    assert base == {i: spans_by_hand(t or "") for i, t in enumerate(texts)} and len(base[4]) > 3 * secrets.LAID_ASIDE / 2
    clean = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for start, _, end in spans_by_hand(t or ""):
            if start >= at:
                want += t[at:start] + "[SECRET]"
            at = max(at, end)
        assert clean[i] == (None if t is None else want + t[at:])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["lorem", "ipsum", "Ünïcode", "中文字", "🙂", "x" * 700, "\n", "token=abcdefghijklmnop"]
    rows = [(2**53 + i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 40, 900))))) for i in range(40)] + [(7, None), (8, ""), (9, "<|endoftext|>")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}", rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_path())
    found.no_padding()
    found.no_truncation()
    return found


def test_op2_digests(spark, folder, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.queries()["op2_bpe"](spark, folder[0]).collect()}
    for i, text in folder[1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op6_pieces_and_places(spark, folder, library):
    size, places, total = packing.SEQUENCE, {}, 0
    found = {(r.doc_id, r.piece): r for r in registry.queries()["op6_best_fit_packing"](spark, folder[0]).collect()}
    for i, text in folder[1]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces, at = -(-len(ids) // size), 0
        total += len(ids)
        for k in range(pieces):
            r = found.pop((i, k))
            length = len(ids) - size * (pieces - 1) if k == 0 else size
            assert (r.start, r.length, r.ids_crc32) == (at, length, zlib.crc32(ids[at : at + length].tobytes()))
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += length
    assert not found
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))] and sum(n for _, n in parts) <= size
    assert len(places) <= 1.1 * total / size + 1
