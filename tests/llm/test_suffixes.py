"""Repeated passages against brute force over all windows of words."""

import random
import time

import pytest

from murmuration import session
from murmuration.llm import suffixes
from murmuration.llm.common import staged, tidy_shuffles


def brute(docs, least):
    """spans and class of each document, by looking every window up."""
    where = {}
    for i, words in docs.items():
        for a in range(len(words) - least + 1):
            where.setdefault(tuple(words[a : a + least]), set()).add(i)
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    spans = {}
    for i, words in docs.items():
        hit = [len(where[tuple(words[a : a + least])]) > 1 for a in range(len(words) - least + 1)]
        out = []
        for a in (a for a, h in enumerate(hit) if h):
            for j in where[tuple(words[a : a + least])]:
                x, y = sorted((root(i), root(j)))
                label[y] = x
            if out and a <= out[-1][1]:
                out[-1][1] = a + least
            else:
                out.append([a, a + least])
        spans[i] = ",".join(f"{a}:{b}" for a, b in out)
    return {i: (spans[i], root(i)) for i in docs}


@pytest.mark.parametrize("batch", [3, 10000])
def test_equals_brute_force(spark, batch):
    """A hot passage, chains of partners that agree to different sides, texts that are whole copies, repeats inside a text."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 9999)}"
    base = [word() for _ in range(60)]
    docs = {}
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            words += base[a : a + rng.randint(8, 30)] + [word() for _ in range(rng.randint(0, 9))]
        if i % 7 == 0:
            words += ["hot"] * 14 + base[:12]
        if i % 11 == 0 and i:
            words = list(docs[i - 1])
        docs[i] = words
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        table = spark.createDataFrame([(i, " ".join(w), 0) for i, w in docs.items()] + [(3, " ".join(docs[3]), 1)], "doc_id long, text string, doc int")
        found = {r.doc_id: (r.spans, r.class_id) for r in suffixes.repeated_passages(table, least=12, gram=3, window=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(docs, 12)
    assert found == want
    assert len({c for _, c in want.values()}) > 5 and sum(bool(s) for s, _ in want.values()) > 15


def test_odd_rows(spark):
    big = 2**53 + 1
    same = " ".join(f"p{i}" for i in range(60))
    rows = [(big, same), (None, same), (5, None), (6, ""), (7, "a b")]
    found = {r.doc_id: (r.spans, r.class_id, r.class_size) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {big: ("0:60", big, 2), None: ("0:60", big, 2), 5: ("", 5, 1), 6: ("", 6, 1), 7: ("", 7, 1)}


def test_disk(spark, tmp_path, monkeypatch):
    """Tables that were sorted are gone, those that stay hold no keys of runs that are settled, and the session's setting is as before."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 9999)}"
    long = [word() for _ in range(400)]
    docs = {i: long[i:] if i < 6 else [word() for _ in range(80)] for i in range(12)}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {r.doc_id: (r.spans, r.class_id) for r in suffixes.repeated_passages(table).collect()}
    assert found == brute(docs, 50)
    assert spark.conf.get(key, None) == before
    kept = {p.name.rpartition("-")[0]: str(p) for p in tmp_path.iterdir()}
    assert not {"suffixes", "windows"} & set(kept)
    matched = spark.read.parquet(kept["windows-matched"])
    assert matched.filter("kind = 0").count() > 1500
    assert matched.filter("kind = 0 and (key is not null or `check` is not null)").isEmpty()
    assert matched.filter("kind <> 0 and (key is null or `check` is null)").isEmpty()


def test_shuffle_files_go_with_their_query(spark):
    """Without the driver's collector: a write's shuffle is gone as it ends."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {b.name() for b in (x.apply(i) for x in [blocks.getAllBlocks()] for i in range(x.size())) if b.name().startswith("shuffle_")}

    there = files()
    with tidy_shuffles(spark):
        staged(spark.range(1000).repartition(3, "id"), "tidy")
    until = time.time() + 20  # executors delete them on their own time
    while files() - there and time.time() < until:
        time.sleep(0.1)
    assert not files() - there
