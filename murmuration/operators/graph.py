"""Graph operators: connected components, set-overlap edges, communities and their density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.kernels import list_propagation
from murmuration.operators.overlap import Overlaps, numbered, packed_lists
from murmuration.session import written

#: Nodes and neighbours of a task that propagates labels, unless a component has more.
NODES, NEIGHBOURS = 200_000, 1 << 25


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b); a component is named by its least node.

    Labels fall to the least one among neighbours and then to their label's label; each round is written.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("near"))
        jump = step.groupBy("label").agg(F.min("near").alias("hook"))
        after = step.join(jump.withColumnRenamed("label", "of"), F.col("near") == F.col("of"), "left").join(jump.select(F.col("label").alias("own"), F.col("hook").alias("mine")), F.col("label") == F.col("own"), "left")
        new = F.least("near", F.coalesce("hook", "near"), F.coalesce("mine", "near"))
        after = written(after.select("node", new.alias("label"), (new != F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def overlap_edges(pairs: DataFrame, min_shared: int = 3, overlap: float = 0.5) -> DataFrame:
    """(a, b, shared, total) of owners a < b whose element sets share min_shared or more, and overlap of their union.

    pairs: (owner, element). All pairs that share an element are counted, in sections of bounded memory.
    """
    return Overlaps(pairs, min_shared, overlap).edges()


def forest(lists: DataFrame) -> DataFrame:
    """(a, b) with the components of neighbour lists (id, near): each task keeps the links that join what it hasn't joined yet.

    A task holds four bytes for each id up to the highest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent = np.arange(0, dtype=np.int32)
        for batch in batches:
            for a, near in zip(batch.column("id").to_pylist(), batch.column("near")):
                b = np.frombuffer(near.as_buffer(), np.int32)
                top = max(a, int(b.max())) + 1
                if top > len(parent):
                    parent = np.concatenate([parent, np.arange(len(parent), max(top, 2 * len(parent)), dtype=np.int32)])
                roots = parent[np.append(b, np.int32(a))]
                while True:
                    above = parent[roots]
                    if (above == roots).all():
                        break
                    roots = above
                least = roots.min()
                parent[roots] = parent[b] = parent[a] = least
        while len(parent):
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        b = np.flatnonzero(parent != np.arange(len(parent)))
        for i in range(0, len(b), 1 << 18):
            some = b[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(parent[some], pa.int32()), pa.array(some.astype(np.int32))], ["a", "b"])

    return lists.mapInArrow(run, "a int, b int")


def listed_components(lists: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, component) by names of neighbour lists by ids, which follow the order of names."""
    parts = connected_components(written(forest(lists), "forest"))
    name = lambda key, of: owners.select(F.col("id").alias(key), F.col("owner").alias(of))
    return parts.withColumnsRenamed({"node": "i", "component": "c"}).join(name("i", "node"), "i").join(name("c", "component"), "c").select("node", "component")


def edge_lists(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbour lists (id, near) of edges (a, b), both ways, and owners (id, owner) of the ids."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    owners = numbered(both.select(F.col("a").alias("owner")).distinct(), "owner")
    name = lambda key, of: owners.select(F.col("id").cast("int").alias(key), F.col("owner").alias(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in range(2))
            order = np.argsort(a, kind="stable")
            if len(a):
                yield packed_lists(a[order], b[order])

    ids = both.join(name("i", "a"), "a").join(name("j", "b"), "b").select("i", "j")
    return ids.repartition("i").sortWithinPartitions("i").mapInArrow(run, "id int, near binary"), owners


def listed_communities(lists: DataFrame, owners: DataFrame, sweeps: int = 20) -> DataFrame:
    """(node, community, inside) by in-place label propagation, exactly as over the whole graph: labels never leave a
    component, so tasks take whole ones. inside: neighbours in the same community. lists: all neighbours of each id,
    written. A component's lists must fit in a task, at four bytes a neighbour."""
    parts = connected_components(written(forest(lists), "forest")).withColumnsRenamed({"node": "id"})
    many, most = lists.agg(F.count("*"), F.sum(F.length("near") / 4)).first()
    tasks = max(1, -(-int(many) // NODES), -(-int(most or 0) // NEIGHBOURS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near = [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            near += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("near")]
        if ids:
            node, label, inside = list_propagation(np.concatenate(ids), near, sweeps)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), pa.array(inside)], ["id", "community", "inside"])

    rows = lists.join(parts, "id").repartition(tasks, "component").select("id", "near")
    found = written(rows.mapInArrow(run, "id int, community int, inside long"), "communities")
    name = lambda key, of: owners.select(F.col("id").alias(key), F.col("owner").alias(of))
    return found.withColumnsRenamed({"id": "i", "community": "c"}).join(name("i", "node"), "i").join(name("c", "community"), "c").select("node", "community", "inside")


def communities(edges: DataFrame, sweeps: int = 20) -> DataFrame:
    """(node, community) of edges (a, b) by in-place label propagation: listed_communities."""
    lists, owners = edge_lists(edges)
    return listed_communities(written(lists, "neighbours"), owners, sweeps).select("node", "community")


def listed_density(member: DataFrame, twice: bool) -> DataFrame:
    """(community, size, inside, density) of members (community, inside); twice: each edge is in both its ends' inside."""
    inside = (F.sum("inside") / (2 if twice else 1)).cast("long")
    n = F.col("size")
    density = F.when(n > 1, F.col("inside") / (n * (n - 1) / 2)).otherwise(F.lit(0.0))
    return member.groupBy("community").agg(F.count("*").alias("size"), inside.alias("inside")).withColumn("density", density)


def community_density(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, size, inside, density): edges between members over all possible ones; 0 for a single member."""
    inside = edges.join(member.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    counts = inside.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inside"))
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    n = F.col("size")
    density = F.when(n > 1, F.coalesce("inside", F.lit(0)) / (n * (n - 1) / 2)).otherwise(F.lit(0.0))
    return sizes.join(counts, "community", "left").select("community", "size", F.coalesce("inside", F.lit(0)).cast("long").alias("inside"), density.alias("density"))
