"""Bigram kernels against the column functions and plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmuration.functions import bigrams as B
from murmuration.functions import text as T
from murmuration.operators.kernels import simhash

STOP = frozenset({"th", "an", "é", "long"})


def plain_tokens(text):
    table = {ord(a): b for a, b in zip(T.FULL, T.HALF)} | {ord(x): None for x in T.ZERO_WIDTH}
    x = "".join((text or "").translate(table).split())
    found = [x] if len(x) == 1 else [x[i : i + 2] for i in range(len(x) - 1)]
    return [t for t in found if t not in STOP]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    found = [None, "", " ", "é", "x", "😀", "😀a", "a\r\n b​c　ＡＢ", "th an th an", "的" * 40, "﻿"]
    for letters in ("ab", "abcdefgh  \n", "".join(chr(0x4E00 + i) for i in range(3000)), "a😀é字 "):
        found += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(30)]
    return found


@pytest.mark.parametrize("at_once", [1 << 20, 500])
def test_measures(monkeypatch, texts, at_once):
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    stop = B.stops(STOP)
    array = pa.array(texts, pa.string()).fill_null("")
    rows = [B.tokens(some, stop) + (len(some),) for some in B.pieces(array)]
    assert sum(n for *_, n in rows) == len(texts)
    want = [plain_tokens(x) for x in texts]
    got = [[B.word(t) for t, r in zip(tok.tolist(), row.tolist()) if r == i] for row, tok, n in rows for i in range(n)]
    assert got == want
    for n in (1, 2, 3, 5):
        grams = [[tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in want]
        ratios = [0.0 if len(g) < 4 else 1 - len(set(g)) / len(g) for g in grams]
        assert np.concatenate([B.repeat_ratios(*x, n) for x in rows]).tolist() == pytest.approx(ratios)
    entropy = [math.log2(len(t)) - sum(n * math.log2(n) for n in Counter(t).values()) / len(t) if t else 0.0 for t in want]
    assert np.concatenate([B.entropies(*x) for x in rows]).tolist() == pytest.approx(entropy)
    assert np.concatenate([B.simhashes(*x) for x in rows]).tolist() == [simhash(t) for t in want]
    assert hashlib.blake2b("字a".encode(), digest_size=8).digest() == B.digest(B.number("字a"))


def test_columns(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string").repartition(3)
    want = [plain_tokens(x) for x in texts]
    found = rows.select("id", B.entropy(F.col("text"), STOP).alias("e"), B.repetition(F.col("text"), 3, STOP).alias("m"), B.simhash(F.col("text"), STOP).alias("s")).orderBy("id").collect()
    assert [r.m.n for r in found] == [len(t) for t in want]
    assert [r.s for r in found] == [simhash(t) for t in want]
    counted = {r.token: r.n for r in B.token_counts(rows, STOP).collect()}
    assert counted == Counter(t for x in want for t in x)


def test_compact_and_fold_by_fewer_steps(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    c = F.col("text")
    whole = lambda c: F.regexp_replace(F.translate(F.lower(F.translate(T.normalize(c), "é0", "eo")), "é0", "eo"), r"[^一-鿿a-z0-9]+", "")
    for r in rows.select(T.compact(c).alias("a"), T.without_space(T.normalize(c)).alias("b"), T.fold(c, {"é": "e", "0": "o"}).alias("x"), whole(c).alias("y")).collect():
        assert r.a == r.b and r.x == r.y
    plan = rows.select(T.fold(c, {"é": "e"}).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1
