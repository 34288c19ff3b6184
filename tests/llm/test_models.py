"""Prediction by partial matching and quality statistics against plain Python."""

import random
from collections import Counter
from math import log10
from zlib import crc32

import pytest

from murmuration.llm import ppm, quality

ORDER, END = 5, 255


class Plain:
    """Counts in dictionaries, escapes by method C, symbols of longer contexts excluded."""

    def __init__(self, texts):
        self.counts = [{} for _ in range(ORDER + 1)]
        for t in texts:
            data = bytes([END] * ORDER) + t + bytes([END])
            for at in range(ORDER, len(data)):
                for level in range(ORDER + 1):
                    self.counts[level].setdefault(data[at - level : at], Counter())[data[at]] += 1

    def log10(self, text):
        data, total = bytes([END] * ORDER) + text + bytes([END]), 0.0
        for at in range(ORDER, len(data)):
            excluded = set()
            for level in range(ORDER, -1, -1):
                seen = self.counts[level].get(data[at - level : at])
                left = {s: n for s, n in (seen or {}).items() if s not in excluded}
                if not left:
                    continue
                size = sum(left.values()) + len(left)
                if data[at] in left:
                    total += log10(left[data[at]] / size)
                    break
                total += log10(len(left) / size)
                excluded |= set(left)
            else:
                total -= log10(256 - len(self.counts[0].get(b"", ())))
        return total


def lowered(text):
    return (text or "").encode().translate(ppm.LOWER)


def prose(rng, n):
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "中文", "running", "\t\n", "42", "xx" * 9]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ppm_equals_plain_python(spark):
    rng = random.Random(2)
    training = [*prose(rng, 80), None, ""]
    others = [*prose(rng, 40), "", None, "never seen ÿ \x00 bytes", "the cat sat on the mat", "a" * 300]
    model = ppm.train(spark.createDataFrame([(t,) for t in training], "text string"))
    rows = [(2**53 + i, t, i) for i, t in enumerate(others)]
    found = {r.doc_id - 2**53: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()}
    plain, words = Plain([lowered(t) for t in training]), Counter()
    for t in training:
        words.update(lowered(t).split())
    n, v = sum(words.values()) + len(training), len(words) + 1
    assert model.tokens == n
    for i, t in enumerate(others):
        tokens = lowered(t).split()
        base = sum(log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens) + log10((len(training) + 0.5) / (n + 0.5 * (v + 1)))
        assert found[i].base_score == pytest.approx(base, rel=1e-9)
        assert found[i].score == pytest.approx(plain.log10(lowered(t)), rel=1e-4, abs=1e-4)
        assert (found[i].n_tokens, found[i].n_known) == (len(tokens) + 1, sum(words[w] > 0 for w in tokens) + 1)


def test_ppm_without_training_is_uniform(spark):
    model = ppm.train(spark.createDataFrame([], "text string"))
    found = ppm.score(spark.createDataFrame([(None, "abc")], "doc_id long, text string"), model).first()
    assert found.doc_id is None and found.score == pytest.approx(-4 * log10(256)) and found.n_known == 0


def test_ppm_shares_sum_to_one(spark):
    """Of every context that occurs, and some that don't, the shares of all bytes."""
    rng = random.Random(6)
    model = ppm.train(spark.createDataFrame([(t,) for t in prose(rng, 30)], "text string"))
    np = ppm.np
    for context in (b"\xff" * 5, b"he ca", b"zzzzz", b"e \xff\xff\xff", b"\xe4\xb8\xad\xe6\x96"):
        key = sum(b << 8 * (5 - i) for i, b in enumerate(reversed(context)))
        keys = np.array([key | s for s in range(256)], np.uint64)
        assert (10.0 ** model.log10(keys)).sum() == pytest.approx(1, abs=1e-5)


def test_counts_of_words_are_exact_beyond_float32(spark):
    assert ppm.joined_counts(ppm.np.array([[1, 1], [0, 7], [2**20 - 1, 2**20 - 1]], ppm.np.float32)).tolist() == [2**20 + 1, 7, (2**20 - 1) * (2**20 + 1)]


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    for r in rows.select("doc_id", ppm.held_out(rows["doc_id"]).alias("x")).collect():
        assert r.x == (crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1)


WHITE = " \t\n\v\f\r"


def plain_statistics(text):
    table = str.maketrans(dict.fromkeys(WHITE, " "))
    words = [w for w in text.translate(table).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.translate(table).strip(" "):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)]


def test_quality_counts_equal_plain_python():
    rng = random.Random(4)
    parts = ["a", "b", "ab", "é", "中", "#", "$x", "\n", "\n\n", " \n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "😀", "<|>", " "]
    for n in range(600):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, n % 90)))
        assert quality.statistics(text)[0] == plain_statistics(text), repr(text)


def test_quality_keeps_ids_and_columns(spark):
    big = 2**53 + 1
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(big, text, "x", 1), (None, text, "y", None), (3, None, "z", 2), (3, None, "z", 2)], "doc_id long, text string, kept string, n_words int")
    trees = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.quality(docs, trees).collect()) == [("3", 0, False), ("3", 0, False), (str(big), 40, True), ("None", 40, True)]
    kept = quality.keep_good(docs, trees)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.kept, r.n_words) for r in kept.collect()) == [(str(big), "x", 1), ("None", "y", None)]
