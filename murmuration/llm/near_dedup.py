"""Near-duplicates by Order MinHash with banded alignment.

A sketch holds the SAMPLED occurrence-labelled word k-mers of least hash in the order in which the text has them, so it
is sensitive to edits and to order; a text that repeats k-mers has sketches of its distinct ones too, as similarity is
that of sets. Equal sketches make a bucket. In each bucket documents are compared with a leader,
not with each other; links join components, and buckets that still hold several components get other leaders, and at
last an exact sweep: of their pairs, those whose rarest k-mers allow a link are compared. A pair is a link if the Jaccard similarity of
its k-mers and its edit similarity by banded alignment both reach the threshold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuration.operators.graph import connected_components

from .common import Filter, having, lookup_join, read_table, released, staged, unused
from .suffixes import Rolling, Words, hashed

K, SKETCHES, SAMPLED, SIMILARITY = 5, 24, 3, 0.8
#: Rounds with other leaders before the sweep, texts compared with one copy of a leader's, and texts of a block of the sweep.
ROUNDS, SALT_ROWS, BLOCK = 1, 500, 4096
#: Words from which a pair is first aligned through its common k-mers.
LONG = 2000
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (SKETCHES, 2), dtype=np.uint64) | U(1)


def k_mers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of words; a shorter text is one k-mer."""
    if not len(h):
        return np.zeros(0, U)
    k = min(k, len(h))
    return Rolling(h).at(np.arange(len(h) - k + 1), k)


def labelled(x: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with the number of equal ones before it."""
    by = np.argsort(x, kind="stable")
    s = x[by]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    occurrence = np.empty(len(x), U)
    occurrence[by] = (np.arange(len(s)) - start).astype(U)
    return x + occurrence * U(0xD6E8FEB86659FD93)


def sketch(x: np.ndarray, sketches: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """Order MinHash sketches of the k-mer hashes of one text."""
    if not len(x):
        return np.zeros(0, U)
    y = labelled(x)
    out = np.empty(sketches, U)
    group = max(1, 200_000 // len(y))
    for a in range(0, sketches, group):
        seeds = SEEDS[a : min(sketches, a + group)]
        v = (y[None, :] ^ seeds[:, :1]) * seeds[:, 1:]
        v ^= v >> U(32)
        v *= U(0x9E3779B97F4A7C15)
        n = min(sampled, len(y))
        at = np.sort(np.argpartition(v, n - 1, axis=1)[:, :n], axis=1) if n < len(y) else np.tile(np.arange(n), (len(seeds), 1))
        z = np.zeros(len(seeds), U)
        for i in range(n):
            z = (z ^ y[at[:, i]]) * U(0xBF58476D1CE4E5B9)
            z ^= z >> U(29)
        out[a : a + len(seeds)] = z
    return out


def sketches_of(x: np.ndarray) -> np.ndarray:
    """SKETCHES sketches of the k-mers, and if any repeats so many of the distinct ones in order of first occurrence."""
    first = np.sort(np.unique(x, return_index=True)[1])
    return sketch(x) if len(first) == len(x) else np.concatenate([sketch(x), sketch(x[first])])


def distinct(words: np.ndarray) -> np.ndarray:
    """The sorted distinct k-mers of a table's words."""
    return np.unique(k_mers(words.astype(np.uint32).astype(U) * MIX))


def row_key() -> Column:
    """A digest of doc_id and text; null text counts as empty."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col("text"), F.lit(""))))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, n, sketches, words): node is a digest of the lower-cased words, equal for equal ones; row one of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memory = Words()
        for batch in batches:
            texts = batch.column(2)
            for a in range(0, batch.num_rows, 500):
                node, n, bands, all_words = [], [], [], []
                for i in range(a, min(batch.num_rows, a + 500)):
                    words = (texts[i].as_py() or "").lower().encode().split()
                    h = hashed(words, memory)
                    node.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    x = k_mers(h)
                    n.append(len(np.unique(x)))
                    bands.append(sketches_of(x).view(np.int64))
                    all_words.append((h >> U(32)).astype(np.uint32).view(np.int32))
                sizes = lambda z: pa.array(np.concatenate([[0], np.cumsum([len(b) for b in z])]), pa.int32())
                lists = [pa.ListArray.from_arrays(sizes(z), pa.array(np.concatenate(z))) for z in (bands, all_words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(node)), batch.column(1).slice(a, len(node)), pa.array(node, pa.binary()), pa.array(n, pa.int32()), *lists], names=["doc_id", "row", "node", "n", "sketches", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(released(run), "doc_id long, row string, node binary, n int, sketches array<long>, words array<int>")


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences by alignment in a band of most diagonals on each side; most + 1 if it is larger.

    Furthest-reaching points per diagonal while distances are small, then a banded table.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1

    def slide(i: int, j: int) -> int:
        """Words that agree from i and j on."""
        done, step = 0, 16
        while True:
            s = min(step, n - i - done, m - j - done)
            if s <= 0:
                return done
            differ = a[i + done : i + done + s] != b[j + done : j + done + s]
            at = int(differ.argmax())
            if differ[at]:
                return done + at
            done += s
            step *= 4

    reach = {0: slide(0, 0)}
    if reach[0] == n == m:
        return 0
    for e in range(1, min(most, 48) + 1):
        new = {}
        for d in range(max(-e, -n), min(e, m) + 1):  # diagonal: position in b less position in a
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            i += slide(i, i + d)
            if i == n and i + d == m:
                return e
            new[d] = i
        reach = new
    if most <= 48:
        return most + 1
    # a row of the band: distances at b positions i - most .. i + most
    width = 2 * most + 1
    offsets = np.arange(width)
    far = most + 1
    row = np.where(offsets >= most, offsets - most, far)
    padded = np.full(m + 2 * width, -1, np.int64)
    padded[width : width + m] = b
    for i in range(1, n + 1):
        j = i - most + offsets
        same = padded[width + i - most - 1 : width + i + most] == a[i - 1]
        step = np.minimum(row + ~same, np.append(row[1:], far) + 1)
        step[(j < 0) | (j > m)] = far
        if i <= most:
            step[most - i] = i
        row = np.minimum(np.minimum.accumulate(step - offsets) + offsets, far)
        if row.min() > most:
            return far
    return int(row[m - n + most])


def similar(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """a, b: words; x, y: their sorted distinct k-mers."""
    if len(a) == len(b) and (a == b).all():
        return True
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < threshold * (len(x) + len(y) - both) - 1e-9:
        return False
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    # most long pairs are links by what lies between their common k-mers, without a table of all their words
    return longest > LONG and chained_distance(a, b) <= most or edit_distance(a, b, most) <= most


def chained_distance(a: np.ndarray, b: np.ndarray) -> int:
    """At least the edit distance: of the alignment through the longest chain of k-mers that occur once in each text."""
    once = []
    for w in (a, b):
        x, at, n = np.unique(k_mers(w.astype(np.uint32).astype(U) * MIX), return_index=True, return_counts=True)
        once.append((x[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    ia, ib = once[0][1][i], once[1][1][j]
    by = np.argsort(ia)
    ia, ib = ia[by].tolist(), ib[by].tolist()
    tails: list[int] = []  # the least last place in b of chains of each length, and who has it
    heads: list[int] = []
    before = [-1] * len(ia)
    for at, place in enumerate(ib):
        k = bisect_left(tails, place)
        before[at] = heads[k - 1] if k else -1
        tails[k : k + 1], heads[k : k + 1] = [place], [at]
    chain = []
    at = heads[-1] if heads else -1
    while at >= 0:
        chain.append((ia[at], ib[at]))
        at = before[at]
    chain.reverse()
    k, x, y, cost = min(K, len(a), len(b)), 0, 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        if i < x or j < y:
            if x - i == y - j:
                x, y = i + k, j + k
            continue
        n, m = i - x, j - y
        if n or m:
            cost += edit_distance(a[x:i], b[y:j], max(n, m)) if n * m <= 1 << 20 else max(n, m)
        x, y = i + k, j + k
    return cost


def verified(pairs: DataFrame, words: DataFrame, name: str, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that are links. words: (node, words), maybe several equal rows a node. b may be a hot leader:
    its words are copied for every SALT_ROWS pairs."""
    pairs = staged(pairs.select("a", "b").distinct(), name + "-pairs")
    needed = staged(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), name + "-needed")
    some = staged(having(words, needed, "node").groupBy("node").agg(F.any_value("words").alias("words")), name + "-words")
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    total = pairs.count()
    salted = lookup_join(pairs, salts.withColumn("n", F.col("salts") * SALT_ROWS), ["b"], "n", total).withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int")).select("a", "b", "salt")
    leaders = salts.join(some.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").select("b", "wb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = salted.join(some.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(leaders, ["b", "salt"])

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, np.zeros(0, U)
        for df in it:
            good = np.zeros(len(df), bool)
            for i, (b, wa, wb) in enumerate(zip(df["b"], df["wa"], df["wb"])):
                if b != last:
                    last, mine = b, distinct(wb)
                good[i] = similar(wa, wb, distinct(wa), mine, threshold)
            yield df.loc[good, ["a", "b"]]

    return staged(rows.select("a", "b", "wa", "wb").mapInPandas(released(check), "a binary, b binary"), name)


def _common(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of sketches of one kind in common, which may be none."""
    bands = lambda c, s: nodes.select(F.col("node").alias(c), F.col("sketches").alias(s))
    joined = pairs.join(bands("a", "sa"), "a").join(bands("b", "sb"), "b")
    return joined.select("a", "b", F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x)).alias("common"))


def _labelled(buckets: DataFrame, links: DataFrame | None, name: str) -> DataFrame:
    """The buckets' rows with their nodes' components, of buckets that hold several."""
    labels = connected_components(links).withColumnRenamed("component", "label")
    rows = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = staged(rows, name + "-buckets")
    mixed = rows.groupBy("band", "hash").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).filter("x <> y").drop("x", "y")
    return staged(lookup_join(rows, mixed, ["band", "hash"], "size", rows.count()), name + "-mixed")


def _tokens(words: DataFrame) -> DataFrame:
    """(node, n, token): the n distinct k-mers of each node's words."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for a in range(0, len(df), 200):
                part = df.iloc[a : a + 200]
                found = [distinct(w) for w in part["words"]]
                n = np.array([len(x) for x in found], np.int32)
                token = np.concatenate(found).view(np.int64) if len(found) else np.zeros(0, np.int64)
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), n), "n": np.repeat(n, n), "token": token})

    return words.select("node", "words").mapInPandas(released(run), "node binary, n int, token long")


def _rare(words: DataFrame, threshold: float) -> DataFrame:
    """(node, n, token, at): the rarest k-mers of each node, so many that two nodes as similar as threshold share one.

    at: how many of its k-mers are rarer, counting from 0. words: (node, words) of unique nodes. K-mers that no other
    node has aren't listed but count; nodes with too many of them have no link and no rows.
    """
    tokens = staged(_tokens(words), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1")
    found = lookup_join(tokens, staged(often, "often"), ["token"], "often", tokens.count())
    mine = Window.partitionBy("node")
    found = found.select("*", (F.col("n") - F.count("*").over(mine)).alias("own"), F.row_number().over(mine.orderBy("often", "token")).alias("nth"))
    at = F.col("own") + F.col("nth") - 1
    return found.select("node", "n", "token", at.cast("int").alias("at")).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))


def _sweep(mixed: DataFrame, nodes: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of mixed buckets in different components that share a sketch and may be links.

    Exact: two sets of k-mers as similar as threshold share one among the rarest of each, and by the places of the first
    one that they share there are bounds of what they have in common. A frequent k-mer's nodes are cut into blocks.
    """
    labels = staged(mixed.select("node", "label").distinct(), "swept-nodes")
    some = having(words, labels.select("node"), "node").groupBy("node").agg(F.any_value("words").alias("words"))
    rare = staged(_rare(some, threshold).join(labels, "node"), "rare")
    sizes = rare.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    rows = lookup_join(rare, staged(sizes, "rare-sizes"), ["token"], "size", rare.count()).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # block i meets block j for i <= j: the row goes to (i, j) for its own block as either
    each = F.sequence(F.lit(0), F.col("blocks") - 1)

    def side(name: str, meets: Column) -> DataFrame:
        fields = [F.col(c).alias(c + name) for c in ("node", "label", "n", "at", "block")]
        return rows.select("token", *fields, F.explode(F.filter(each, meets)).alias("other" + name))

    left, right = side("_a", lambda j: j >= F.col("block")), side("_b", lambda i: i <= F.col("block"))
    same = (F.col("other_a") == F.col("block_b")) & (F.col("block_a") == F.col("other_b"))
    once = (F.col("block_a") < F.col("block_b")) | (F.col("node_a") < F.col("node_b"))
    common = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    either = F.greatest(F.col("at_a") + F.col("at_b") + common, F.col("n_a") + F.col("n_b") - common)
    may = (F.col("label_a") != F.col("label_b")) & once & (common >= either * threshold - 1e-9)
    l, r = left.alias("l"), right.alias("r")
    pairs = l.join(r, (F.col("l.token") == F.col("r.token")) & same & may).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    bands = lambda c, s: nodes.select(F.col("node").alias(c), F.col("sketches").alias(s))
    return staged(pairs, "rare-pairs").join(bands("a", "sa"), "a").join(bands("b", "sb"), "b").filter(F.arrays_overlap("sa", "sb")).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, kept, row) of each row; class_id is the least doc_id of its class of linked documents.

    kept: the row whose document stays, one of each class (repeated rows of it have equal row_key()s in row).

    Texts of equal lower-cased words are one class, empty and null ones too. Texts of fewer than K words link only to equal
    ones. Repeated rows stay and count; null doc_ids never are a class_id unless all are. An empty table gives no rows; other
    columns aren't read.
    """
    table = staged(sketched(docs), "sketches")
    words = table.select("node", "words")
    nodes = staged(table.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("sketches").alias("sketches")), "nodes")
    exploded = nodes.select("node", "sketches", F.posexplode("sketches").alias("at", "hash"))
    once = exploded.filter(f"at < {SKETCHES} or hash <> sketches[greatest(at - {SKETCHES}, 0)]")
    buckets = staged(once.select("node", F.pmod("at", F.lit(SKETCHES)).alias("band"), "hash"), "buckets")
    sizes = buckets.groupBy("band", "hash").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    shared = staged(lookup_join(buckets, staged(sizes, "leaders"), ["band", "hash"], "size", buckets.count()), "shared")
    first = shared.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    links = verified(first, words, "links", threshold)
    rows = shared.select("node", "band", "hash")
    mixed = _labelled(rows, links, "labels0")
    for i in range(ROUNDS):
        leaders = mixed.groupBy("band", "hash").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", "band", F.lit(i))).alias("l"), F.first("size").alias("size"))
        met = lookup_join(mixed.drop("size"), staged(leaders, "leaders"), ["band", "hash"], "size", mixed.count())
        pairs = met.filter(F.col("label") != F.col("l.label")).select(F.col("node").alias("a"), F.col("l.node").alias("b")).distinct()
        best = _common(pairs, nodes).groupBy("a").agg(F.max_by("b", "common").alias("b"))
        new = verified(best, words, f"links{i + 1}", threshold)
        if new.isEmpty():
            break
        links = links.union(new)
        mixed = _labelled(mixed.select("node", "band", "hash"), links, f"labels{i + 1}")
    links = links.union(verified(_sweep(mixed, nodes, words, threshold), words, "swept", threshold))
    labels = connected_components(links).withColumnRenamed("component", "label")
    counted = table.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first_row"), F.count("*").alias("copies")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = staged(counted, "counted")
    classes = counted.groupBy("label").agg(F.min("first_row").alias("stays"), F.sum("copies").alias("class_size"), F.count("*").alias("texts"))
    of = lookup_join(counted, classes, ["label"], "texts", counted.count()).select("node", "copies", "stays", "class_size")
    rows = lookup_join(table.select("doc_id", "row", "node"), staged(of, "of"), ["node"], "copies", table.count())
    return rows.select("doc_id", F.col("stays.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("stays.row")).alias("kept"), "row")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The row of docs that stays of each class, with docs' columns, whatever their names; repeated rows of it count once.

    Documents that a filter of the rows of larger classes rules out stay where they are.
    """
    several = near_duplicates(docs, threshold).filter("class_size > 1")
    key, stays, n = (unused(c, docs.columns) for c in ("row", "stays", "n"))
    rows = staged(several.groupBy("row").agg(F.bool_or("kept").alias(stays), F.count("*").alias(n)).withColumnRenamed("row", key), "several")
    out, may = Filter(rows, key).split(docs.withColumn(key, row_key()), key)
    own = [F.col(f"`{c}`") for c in docs.columns]
    looked = lookup_join(may, rows, [key], n, docs.count(), "left")
    alone = looked.filter(F.col(stays).isNull()).select(*own)
    first = looked.filter(F.col(stays)).dropDuplicates([key]).select(*own)
    return out.select(*own).unionByName(alone).unionByName(first)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near_duplicates() of all documents, which defines odd rows; an empty table gives no rows."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
