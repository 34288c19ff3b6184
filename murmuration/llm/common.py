"""Helpers shared by the corpus operators: shared tables and joins that survive hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.session import drop, new_path, written as staged

__all__ = ["Filter", "drop", "having", "lookup_join", "new_path", "read_table", "released", "small_batches", "staged", "tidy_shuffles", "unused"]

#: A key is hot if it holds over one in so many rows; there are fewer than so many of them, whatever the input.
HOT_KEYS = 1000
#: Bits of a filter for each key in it, and at most (8 MB); a filter at its bound lets more rows through that aren't looked for.
FILTER_BITS, FILTER_MOST = 32, 1 << 26
#: Bytes of an Arrow batch beyond which its next rows go to another one.
BATCH = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches hold BATCH bytes and a row at most, however long their texts are.

    Spark's own bounds are 10,000 rows and 64 MB; executors and Python workers hold several copies of a batch, and
    workers keep for later stages what they took once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as it ends; else they stay until the driver happens to collect its garbage.

    For writes: what is read again would be shuffled again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow or mapInPandas; at a task's end its worker, which waits for others, returns free memory."""

    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps it otherwise
            if trim:
                trim(0)

    return over


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, total: int, how: str = "inner") -> DataFrame:
    """Joins many left rows to the unique right row of their key; count_col of right is the key's number of left rows.

    Keys with over total / HOT_KEYS rows are fewer than HOT_KEYS, so their right rows are broadcast; no task of the
    shuffled rest gets more rows of a key than total / HOT_KEYS. left is read twice: pass a staged table.
    """
    hot = F.broadcast(right.filter(F.col(count_col) * HOT_KEYS > total))
    cold = right.filter(F.col(count_col) * HOT_KEYS <= total)
    a = left.join(hot, keys, "inner")
    b = left.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return a.unionByName(b)


class Filter:
    """A Bloom filter of keys, with one bit each, as a bounded table (word, bits) that is broadcast."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        n = keys.count()
        self.size = min(FILTER_MOST, 1 << max(6, (n * FILTER_BITS - 1).bit_length()))
        bit = F.pmod(F.xxhash64(key), F.lit(self.size))
        words = keys.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("at"))
        self.words = staged(words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")), "filter")

    def split(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose key the filter rules out, and the others."""
        columns = [F.col(f"`{c}`") for c in rows.columns]
        word, bits = (unused(c, rows.columns) for c in ("filter_word", "filter_bits"))
        bit = F.pmod(F.xxhash64(key), F.lit(self.size))
        found = rows.join(F.broadcast(self.words.toDF(word, bits)), F.shiftright(bit, 6) == F.col(word), "left")
        may = F.expr(f"shiftrightunsigned(coalesce({bits}, 0L), cast(pmod(pmod(xxhash64({key}), {self.size}L), 64L) as int)) & 1") == 1
        return found.filter(~may).select(*columns), found.filter(may).select(*columns)


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys, unique there; a filter rules most others out before any move."""
    return Filter(keys, key).split(rows, key)[1].join(keys, key, "left_semi")
