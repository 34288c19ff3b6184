"""Clusters, fingerprints, common segments and communities against plain Python."""

import hashlib
import random

from murmuration.operators import coordination
from murmuration.operators.graph import communities
from murmuration.operators.kernels import longest_common_segment, simhash
from murmuration.sources.dataset import Dataset


def bigrams(text):
    return [text[i : i + 2] for i in range(len(text) - 1)] or [text]


def plain_simhash(toks):
    votes = [0] * 64
    for t in toks:
        n = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        for i in range(64):
            votes[i] += 1 if n >> i & 1 else -1
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def plain_segment(a, b):
    """Length of the longest common run, by a table, and the first ends in scan order."""
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                if new[j + 1] > best[0]:
                    best = (new[j + 1], i + 1 - new[j + 1], j + 1 - new[j + 1])
        row = new
    return best


def test_simhash_and_segments():
    rng = random.Random(1)
    for _ in range(300):
        toks = ["".join(rng.choice("abc中文") for _ in range(2)) for _ in range(rng.randint(0, 30))]
        assert simhash(toks) % 2**64 == plain_simhash(toks)
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        assert longest_common_segment(a, b) == plain_segment(a, b)


def plain_clusters(rows, similarity, ratio, least):
    found = []
    for topic in sorted({t for t, _, _ in rows}):
        texts = [(i, a, x) for i, (t, a, x) in enumerate(rows) if t == topic and len(x) >= 8]
        prints = [plain_simhash(bigrams(x)) for _, _, x in texts]
        taken = set()
        for i in range(len(texts)):
            if i in taken:
                continue
            group = [i]
            for j in range(i + 1, len(texts)):
                near = 1 - (prints[i] ^ prints[j]).bit_count() / 64 >= similarity and (prints[i] or prints[j])
                a, b = texts[i][2], texts[j][2]
                if j not in taken and near and plain_segment(a, b)[0] / max(len(a), len(b)) >= ratio:
                    group.append(j)
            if len(group) >= least:
                taken |= set(group)
                if len({texts[k][1] for k in group}) >= least:
                    found.append((topic, tuple(str(texts[k][0]) for k in group)))
    return sorted(found)


def test_clusters(spark):
    rng = random.Random(5)
    letters = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(8, 24))) for _ in range(12)]
    rows = []
    for _ in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(letters)
        rows.append((f"t{rng.randint(0, 2)}", f"a{rng.randint(0, 40)}", "".join(text) + rng.choice(["", "", "了", "好极了"])))
    items = spark.createDataFrame([(i, str(i), a, x, t) for i, (t, a, x) in enumerate(rows)], "seq long, item_id string, actor_id string, text string, topic string")
    want = plain_clusters(rows, 0.72, 0.5, 3)
    assert len(want) > 8
    for most in (None, 400):
        found = coordination.clusters(Dataset.of(items), frozenset(), 0.72, 0.5, 3, 3, 8, most)
        assert sorted((r.topic, tuple(r.item_ids)) for r in found.collect()) == want
    few = [r for t in ("t0", "t1", "t2") for r in [x for x in rows if x[0] == t][:20]]
    capped = coordination.clusters(Dataset.of(items), frozenset(), 0.72, 0.5, 3, 3, 8, 20)
    names = {(t, a, x): str(i) for i, (t, a, x) in reversed(list(enumerate(rows)))}
    assert sorted(r.topic for r in capped.collect()) == [t for t, _ in plain_clusters(few, 0.72, 0.5, 3)] and names


def test_communities(spark):
    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(g * 12, g * 12 + 12)], 2))) for g in range(4) for _ in range(22)} | {("n00", "n12")})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in range(20):
        before = dict(label)
        for n in sorted(near):
            votes = [label[m] for m in near[n]]
            label[n] = min(set(votes), key=lambda x: (-votes.count(x), x))
        if label == before:
            break
    names = {x: min(n for n in label if label[n] == x) for x in label.values()}
    found = {r.node: r.community for r in communities(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {n: names[x] for n, x in label.items()}
