"""Kernels and queries whose time must not grow with the square of a text's length."""

import random
import time

from murmuration.operators.kernels import anchors, greedy_clusters, greedy_copies
from murmuration.plans import catalog


def test_copy_pairs_of_long_texts(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh字é") for _ in range(n))
    run = text(1500)
    long = [(1, t, text(14000) + run + text(14000)) for t in range(4)] + [(2, 0, text(30000)), (2, 1, text(30000)), (2, 2, None), (2, 3, "")]
    spark.createDataFrame(long, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.perf_counter()
    found = sorted((r.topic, r.a, r.b) for r in catalog.copy_pairs(spark, str(tmp_path)).collect())
    assert found == [("1", a, b) for a in range(4) for b in range(a + 1, 4)]
    assert time.perf_counter() - began < 20


def test_anchors_of_a_long_text():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    began = time.perf_counter()
    found = anchors(text, 0.5)
    assert time.perf_counter() - began < 5
    assert set(found) & set(anchors("x" * 190_000 + text[50_000:255_000], 0.5))


def test_greedy_pass_over_copies():
    rng = random.Random(6)
    for _ in range(300):
        first = {}
        for rank in range(30):
            first[rank] = rng.choice([rank, *(x for x in first.values())])
        firsts = sorted(set(first.values()))
        links = {tuple(sorted(rng.sample(firsts, 2))) for _ in range(rng.randint(0, 12)) if len(firsts) > 1} | {(x, x) for x in firsts if rng.random() < 0.7}
        edges = [(i, j) for i in first for j in first if i < j and tuple(sorted((first[i], first[j]))) in links]
        least = rng.randint(2, 5)
        assert greedy_copies(sorted(links), [(f, r) for r, f in first.items()], least) == greedy_clusters(edges, least)
