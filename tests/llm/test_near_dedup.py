"""Near-duplicates against all pairs: families of copies around the threshold, small blocks, long texts, odd rows."""

import random

import numpy as np

from murmuration.llm import common, near_dedup


def copies(rng, words, share):
    """words with edits at random places: replaced, deleted and inserted ones."""
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        elif (kind := rng.random()) < 0.5:
            out.append(f"n{rng.randint(0, 10**8)}")
        elif kind < 0.75:
            out += [w, f"i{rng.randint(0, 10**8)}"]
    return out


def all_pairs(texts):
    """Classes of links by set similarity and edit distance of all pairs of texts."""
    ids = {}
    words = [np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in texts]
    shingles = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    label, links = list(range(len(texts))), 0
    for j in range(len(texts)):
        for i in range(j):
            x, y = shingles[i], shingles[j]
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)) or 5 * len(x & y) < 4 * len(x | y):
                continue
            most = max(len(words[i]), len(words[j])) // 5
            if near_dedup.edit_distance(words[i], words[j], most) <= most:
                links += 1
                low, high = sorted((label[i], label[j]))
                label = [low if c == high else c for c in label]
    return label, links


def test_families_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rng = random.Random(21)
    texts = []
    for size, n in ((120, 90), (60, 40), (25, 30)):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        variants = [copies(rng, base, 0.05) for _ in range(4)]
        texts += [copies(rng, rng.choice(variants), rng.choice((0.0, 0.01, 0.03, 0.06))) for _ in range(n)]
    label, links = all_pairs(texts)
    assert links > 300 and 40 < len(set(label)) < 150
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_chained_distance_bounds_edit_distance():
    rng = random.Random(5)
    for share in (0.001, 0.02, 0.1, 0.3):
        words = [rng.randint(0, 3000) for _ in range(1500)]
        other = [rng.randint(3001, 9000) if rng.random() < share else w for w in words if rng.random() >= share / 3]
        a, b = np.array(words), np.array(other)
        exact = near_dedup.edit_distance(a, b, 1500)
        assert exact <= near_dedup.chained_distance(a, b) <= max(len(a), len(b))
        if share < 0.05:
            assert near_dedup.chained_distance(a, b) <= exact * 1.1 + 1


def test_keep_one_of_odd_rows(spark):
    big, text = 2**53 + 1, " ".join(f"w{i}" for i in range(80))
    data = [(big, text, "a", 1), (big, text, "a", 1), (big + 2, text.upper(), "b", 2), (None, text + " more", "c", 3), (1, None, "d", 4), (2, "", "e", 5), (3, "alone here", "f", 6), (3, "alone here", "f", 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, row string, stays int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.row, r.stays) for r in kept.collect()) == [(1, "d", 4), (3, "f", 6), (big, "a", 1)]
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
