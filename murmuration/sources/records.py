"""Raw records: JSON lines in and out, with the order of lines."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuration.session import written


def with_order(df: DataFrame) -> DataFrame:
    """A file scan with seq, the number of its row in order of file, block and line, dense from 0.

    The rows of each block are counted first; a running sum over the counts, one row a block, says where each begins.
    """
    rows = df.withColumn("file_", F.input_file_name()).withColumn("block_", F.input_file_block_start()).withColumn("id_", F.monotonically_increasing_id())
    blocks = rows.groupBy("file_", "block_").agg(F.min("id_").alias("first_"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = written(blocks.select("file_", "block_", (before - F.col("first_")).alias("shift_")), "blocks")
    joined = rows.join(shift, ["file_", "block_"])
    return joined.withColumn("seq", F.col("id_") + F.col("shift_")).drop("file_", "block_", "id_", "shift_")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, line) of the lines that aren't blank."""
    text = with_order(spark.read.text(path))
    return text.select((F.col("seq") + 1).alias("line_no"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line")).filter("line <> ''")


def read_jsonl(spark: SparkSession, path: str, warn: bool = True) -> DataFrame:
    """(seq, record variant) of the lines that hold a JSON object; the first bad lines' numbers are warned of."""
    parsed = read_lines(spark, path).withColumn("record", F.try_parse_json("line"))
    if warn and (bad := [r.line_no for r in bad_lines(parsed).orderBy("line_no").limit(5).collect()]):
        warnings.warn(f"{path}: lines without a JSON object were skipped, first {bad}", stacklevel=2)
    return parsed.filter(is_object("record")).select((F.col("line_no") - 1).alias("seq"), "record")


def is_object(name: str):
    return F.coalesce(F.schema_of_variant(name).startswith("OBJECT"), F.lit(False))


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~is_object("record")).select("line_no")


def from_dicts(spark: SparkSession, records: Iterable[Any]) -> DataFrame:
    """(seq, record variant) of records in memory; what isn't a dict has a null record, what can't be iterated raises TypeError."""
    rows = [(i, json.dumps(r, ensure_ascii=False, default=str) if isinstance(r, dict) else None) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "seq long, line string").select("seq", F.try_parse_json("line").alias("record"))


def write_jsonl(df: DataFrame, path: str, append: bool = False, single: bool = False) -> int:
    """Writes a JSON object a row and returns their number; single: in one file."""
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    n = df.count()
    (lines.coalesce(1) if single else lines).write.mode("append" if append else "overwrite").text(path)
    return n
