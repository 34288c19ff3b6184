"""Exact dedup with a log-structured merge index of digests.

Memtables (batches of (digest, identifier)) are folded by digest and flushed as sorted runs. Compaction merges all runs in
digest order and keeps, for each digest, the identifier that stays (smallest or largest) and the number of rows. The merged
run's filter holds the digests of several rows: documents that it rules out are unique and never look into the index nor
move. The others are looked up, and the bytes of each hit are compared with those of its group; digests under which texts
differ are resolved by whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, lookup_join, new_path, read_table, staged, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a memtable; bounds a task's memory (about 100 bytes a row).
MEMTABLE_ROWS = 200_000


def normalised(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _fold(t: pa.Table, largest: bool) -> pa.Table:
    """One row for each digest: its best identifier and the sum of n, sorted by digest."""
    t = t.append_column("none", pc.is_null(t["doc_id"]))
    # null identifiers are the least preferred ones; ties go by the row number
    side = "descending" if largest else "ascending"
    t = t.sort_by([("digest", "ascending"), ("none", "ascending"), ("doc_id", side), ("row", side)]).drop_columns("none").combine_chunks()
    digest = t["digest"].combine_chunks()
    first = np.flatnonzero(np.concatenate([[True], pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)])) if len(t) else np.zeros(0, int)
    sums = np.add.reduceat(t["n"].to_numpy(), first) if len(t) else np.zeros(0, np.int64)
    return t.take(pa.array(first)).set_column(3, "n", pa.array(sums, pa.int64()))


class DigestIndex:
    """digest -> (identifier that stays, rows). keep: "smallest" or "largest" identifier; nulls stay only among nulls.

    An index of no rows is empty; each insert adds runs, and compaction leaves one.
    """

    SCHEMA = "digest string, doc_id long, row long, n long"

    def __init__(self, spark: SparkSession, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep: {keep}")
        self.spark, self.keep, self.memtable_rows = spark, keep, memtable_rows
        self.runs: list[str] = []
        self.index: DataFrame | None = None

    def insert(self, rows: DataFrame) -> None:
        """rows: (digest string, doc_id long, row long). Each task fills memtables and flushes each as a sorted run."""
        largest, size = self.keep == "largest", self.memtable_rows

        def memtables(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            n = 0
            for b in it:
                held.append(b)
                n += b.num_rows
                if n >= size:
                    yield from _fold(pa.Table.from_batches(held), largest).combine_chunks().to_batches()
                    held, n = [], 0
            if held:
                yield from _fold(pa.Table.from_batches(held), largest).combine_chunks().to_batches()

        path = new_path(self.spark, "run")
        rows.select("digest", "doc_id", "row", F.lit(1).cast("long").alias("n")).mapInArrow(memtables, self.SCHEMA).write.parquet(path)
        self.runs.append(path)

    def compact(self) -> DataFrame:
        """Merges the runs into one: (digest, keep_id, keep_row, group_size), sorted by digest in each file.

        Digests are spread over tasks by their hash; a task merges its share of every run in digest order and folds the
        rows of a digest as they pass, so it holds a batch and one open digest.
        """
        largest = self.keep == "largest"
        runs = self.spark.read.schema(self.SCHEMA).parquet(*self.runs)

        def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["digest", "keep_id", "keep_row", "group_size"]
            held: pa.Table | None = None  # the open digest
            for b in it:
                t = pa.Table.from_batches([b])
                if not len(t):
                    continue
                t = _fold(pa.concat_tables([held, t]) if held is not None else t, largest)
                held = t.slice(len(t) - 1)
                yield from t.slice(0, len(t) - 1).rename_columns(names).combine_chunks().to_batches()
            if held is not None:
                yield from held.rename_columns(names).combine_chunks().to_batches()

        merged = runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(merge, "digest string, keep_id long, keep_row long, group_size long")
        self.index = staged(merged, "index")
        return self.index

    def hits(self) -> DataFrame:
        """The index's rows of digests that several rows have."""
        assert self.index is not None, "compact first"
        return self.index.filter("group_size > 1")


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise=normalised, digest=sha256_digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), row.

    Texts are equal if their normalised bytes are; of equal texts the row with the smallest (or largest) doc_id stays.
    Null text counts as empty; a null doc_id is the last to stay; of repeated rows with one doc_id one stays. An empty
    table gives no rows; other columns than doc_id and text aren't read. Hot groups: index rows of hot digests are
    broadcast (at most HOT_KEYS), and texts are compared by folds before they move, so no task gets a whole group.
    """
    return _found(docs, keep, normalise, digest)[0]


def _found(docs: DataFrame, keep: str, normalise=normalised, digest=sha256_digest) -> tuple[DataFrame, Filter]:
    """The rows of exact_dedup and the filter of the digests that several rows have."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.col("text")).alias("t"))
    keys = staged(text.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("t")).alias("digest"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")), "digests")
    index = DigestIndex(spark, keep)
    index.insert(keys)
    index.compact()
    hits = index.hits()
    several = Filter(hits, "digest")
    alone, may = several.split(keys, "digest")
    may = staged(may, "looked-up")
    found = lookup_join(may, hits, ["digest"], "group_size", keys.count(), "left")
    alone = alone.select("*", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    # what the filter let through without need has no row in hits
    none = F.col("group_size").isNull()
    found = found.select(*may.columns, F.when(none, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    found = staged(alone.unionByName(found), "found")
    wrong = _unequal(text, digest, several)
    if not wrong.isEmpty():
        found = _by_text(text, digest, found, wrong, keep)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row"), several


def _unequal(text: DataFrame, digest, several: Filter) -> DataFrame:
    """The digests under which texts differ: each hit's bytes are compared with its group's least and greatest, before any move."""
    texts = several.split(text.withColumn("digest", digest(F.col("t"))), "digest")[1]
    return staged(texts.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").select("digest"), "unequal")


def _by_text(text: DataFrame, digest, found: DataFrame, wrong: DataFrame, keep: str) -> DataFrame:
    """Groups the rows of colliding digests by their whole texts."""
    bad = found.join(wrong, "digest", "left_semi").drop("keep_id", "keep_row", "group_size")
    texts = text.withColumn("digest", digest(F.col("t"))).join(wrong, "digest", "left_semi").dropDuplicates(["doc_id", "digest", "t"])
    sha = F.sha2(F.col("t").cast("binary"), 256)
    bad = bad.alias("a").join(texts.withColumn("s", sha).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.s"))).select("a.*", "b.t")
    by = F.max(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "row")) if keep == "largest" else F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row"))
    groups = bad.groupBy("t").agg(by.alias("k"), F.count("*").alias("group_size")).select("t", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size")
    return found.join(wrong, "digest", "left_anti").unionByName(bad.join(groups, "t").drop("t"))


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The row of docs that stays of equal texts, with docs' columns, whatever their names; repeated rows of it count once.

    Documents that the filter rules out stay where they are; the others are looked up, hot texts by broadcast.
    """
    found, several = _found(docs, keep)
    hits = found.filter("group_size > 1")
    sha, stays, size = (unused(c, docs.columns) for c in ("text_sha256", "stays", "group_size"))
    groups = staged(hits.groupBy("text_sha256").agg(F.any_value("keep_id").alias("keep_id"), F.first("group_size").alias("n")), "groups")
    groups = groups.select(F.col("text_sha256").alias(sha), F.struct("keep_id").alias(stays), F.col("n").alias(size))
    out, may = several.split(docs.withColumn(sha, sha256_digest(normalised(F.col("text")))), sha)
    own = [F.col(f"`{c}`") for c in docs.columns]
    looked = lookup_join(may, groups, [sha], size, found.count(), "left")
    alone = looked.filter(F.col(stays).isNull()).select(*own)
    first = looked.filter(F.col(stays).isNotNull() & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{stays}.keep_id"))).dropDuplicates([sha]).select(*own)
    return out.select(*own).unionByName(alone).unionByName(first)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup of all documents, the largest doc_id staying; its defined results for odd rows are exact_dedup's."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest").drop("row")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
