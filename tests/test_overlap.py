"""Overlap edges in sections of bounded memory, and the graph operators on neighbour lists, against plain Python."""

import random

import numpy as np
import pytest

from murmuration.operators import graph, overlap
from murmuration.operators.kernels import list_propagation


def plain_edges(sets, least, ratio):
    names = sorted(x for x in sets if len(sets[x]) >= max(1, least))
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = len(sets[a] & sets[b])
            total = len(sets[a] | sets[b])
            if shared >= max(1, least) and shared / total >= ratio:
                out.append((a, b, shared, total))
    return sorted(out)


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(3)
    found = {f"o{i:03d}": set(rng.sample(range(300), rng.randint(1, 12))) | set(rng.sample(range(1000, 1008), rng.randint(0, 8))) for i in range(150)}
    for i in range(0, 150, 7):
        found[f"c{i:03d}"] = set(sorted(found[f"o{i:03d}"])[:-1]) | {5000 + i}
    return found


@pytest.mark.parametrize("held,dense", [(1 << 24, 150), (64, 150), (64, 0), (64, 10**9)])
def test_edges_in_sections(spark, monkeypatch, sets, held, dense):
    monkeypatch.setattr(overlap, "HELD", held)
    monkeypatch.setattr(overlap, "CHUNK", 20 * held)
    monkeypatch.setattr(overlap, "DENSE", dense)
    monkeypatch.setattr(overlap, "AT_ONCE", 500)
    monkeypatch.setattr(overlap, "EXPANDED", 50)
    monkeypatch.setattr(overlap, "ROWS", 3)
    pairs = spark.createDataFrame([(o, str(e)) for o, s in sets.items() for e in s], "owner string, element string").repartition(3)
    for least, ratio in ((3, 0.3), (1, 0.0), (2, 0.6)):
        whole = overlap.Overlaps(pairs, least, ratio, whole=True)
        assert whole.sections.count() == 1 or held == 64
        want = plain_edges(sets, least, ratio)
        plan, size = whole.sections, dict(whole.owners.select("id", "size").collect())
        names = dict(whole.owners.select("id", "owner").collect())
        # the sections in this process, where the bounds above hold
        for both in (False, True):
            plan.whole = both
            rows = {}
            batches = [b for b in whole.lists.toArrow().to_batches()]
            for batch in [*plan.pack_sets(batches), *plan.pack_sizes(whole.owners.select("id", "size").toArrow().to_batches())]:
                section, *rest = (batch.column(i)[0].as_py() for i in range(6))
                rows.setdefault(section, []).append(tuple(rest))
            got = [e for s in sorted(rows) for a, b, n, t in plan.met_pairs(s, rows[s], least, ratio) for e in zip(a.tolist(), b.tolist(), n.tolist(), t.tolist())]
            named = sorted((names[a], names[b], n, t) for a, b, n, t in got)
            assert named == (sorted(want + [(b, a, n, t) for a, b, n, t in want]) if both else want)
        assert len(size) == len(names)
    if held == 64:
        assert plan.runs > 1 and plan.chunks > 1


def test_edges_and_components(spark, sets):
    pairs = spark.createDataFrame([(o, str(e)) for o, s in sets.items() for e in s], "owner string, element string").repartition(3)
    want = plain_edges(sets, 3, 0.5)
    assert len(want) > 15
    assert sorted(map(tuple, graph.overlap_edges(pairs, 3, 0.5).collect())) == want
    met = overlap.Overlaps(pairs, 3, 0.5)
    found = {r.node: r.component for r in graph.listed_components(met.neighbours(), met.owners).collect()}
    label = {x: x for e in want for x in e[:2]}
    for _ in label:
        for a, b, _, _ in want:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_lists_of_a_node_in_parts():
    near = {0: [1, 2], 1: [0, 2], 2: [0, 1, 3], 3: [2, 4, 5], 4: [3, 5], 5: [3, 4], 9: [11], 11: [9]}
    ids = [2, 0, 1, 2, 3, 4, 5, 9, 11]
    rows = [[0, 1], [1, 2], [0, 2], [3], [2, 4, 5], [3, 5], [3, 4], [11], [9]]
    nodes, label, inside = list_propagation(np.array(ids), [np.array(x, np.int32) for x in rows])
    assert nodes.tolist() == sorted(near)
    assert inside.tolist() == [sum(dict(zip(nodes.tolist(), label))[y] == c for y in near[x]) for x, c in zip(nodes.tolist(), label)]
    assert label[-2:].tolist() == [9, 9]
