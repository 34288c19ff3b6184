"""Exact dedup against brute force, with runs and batches of a few rows, hot groups and odd columns."""

import hashlib
import random

import pytest

from murmuration.llm import common, exact_dedup

BIG = 2**53 + 1


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows():
    rng = random.Random(3)
    texts = [None, "", "A", "a", "É", "é", "Hot Text", "hot text"] + [f"t{i}" for i in range(40)]
    found = [(BIG + i, rng.choice(texts[6:8]) if i % 3 == 0 else rng.choice(texts)) for i in range(600)]
    return found + found[:20] + [(None, "hot text"), (None, "only null"), (None, "only null")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(data, largest):
    groups = {}
    for i, text in data:
        groups.setdefault(lowered(text), []).append(i)
    best = lambda ids: (max if largest else min)((i for i in ids if i is not None), default=None)
    return sorted((str(i), str(best(groups[lowered(t)])), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in data)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equals_brute_force(spark, small_batches, monkeypatch, keep):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 11)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    data = rows()
    found = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3), keep).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == brute(data, keep == "largest")
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_MOST", 64)
    data = rows()
    found = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"), "largest").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == brute(data, True)


def test_keep_one_with_clashing_columns(spark):
    data = [(i, t, "m", 1, 2, "x") for i, t in rows()]
    schema = "doc_id long, text string, text_sha256 string, group_size long, filter_bits long, `odd.name` string"
    kept = exact_dedup.keep_one(spark.createDataFrame(data, schema), "largest")
    found = kept.collect()
    assert kept.columns == ["doc_id", "text", "text_sha256", "group_size", "filter_bits", "odd.name"]
    want = {(keep, sha) for _, keep, _, sha in brute(rows(), True)}
    assert len(found) == len(want)
    assert {(str(r.doc_id), hashlib.sha256(lowered(r.text).encode()).hexdigest()) for r in found} == want


def test_index_merges_runs_of_several_inserts(spark, small_batches):
    index = exact_dedup.DigestIndex(spark, "smallest", memtable_rows=5)
    for a in (0, 40, 80):
        index.insert(spark.createDataFrame([(f"d{(i * 7) % 30:02d}", i, i) for i in range(a, a + 40)], "digest string, doc_id long, row long"))
    found = {r.digest: (r.keep_id, r.group_size) for r in index.compact().collect()}
    assert len(index.runs) == 3 and found == {f"d{k:02d}": (min(i for i in range(120) if (i * 7) % 30 == k), 4) for k in range(30)}
