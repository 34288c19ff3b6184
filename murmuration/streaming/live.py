"""The signals that need no look at the whole data, over streams: texts item by item, bursts in sliding windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.functions.scalars import isoformat
from murmuration.operators.hits import TEXT, Context, build_signals
from murmuration.sources.dataset import Dataset, as_items
from murmuration.sources.fieldmap import Adapter
from murmuration.sources.rules import RuleBook


def read_items(spark: SparkSession, folder: str, adapter: Adapter | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Items of JSON-lines files as they arrive in a folder; lines that aren't records are left out, and seq is 0."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return (adapter or Adapter()).items(lines.select(F.lit(0).cast("long").alias("seq"), F.try_parse_json("value").alias("record")))


def text_hits(items: DataFrame, cfg: Config | None = None, rules: RuleBook | None = None) -> DataFrame:
    """Hits of the enabled text signals on a stream (or a table) of items, with no state."""
    cfg = cfg or Config.default()
    rules = rules if rules is not None else RuleBook.load(cfg.get("corpus.rules_dir") or None)
    data = Dataset(as_items(items), items, "stream")
    plans = [s.plan(Context(data, rules, cfg.signal_cfg(s.name))) for s in build_signals(cfg) if s.kind == TEXT]
    return reduce(DataFrame.unionByName, plans)


def live_bursts(items: DataFrame, window_seconds: int = 300, min_items: int = 8, min_actors: int = 3, late_seconds: int = 600) -> DataFrame:
    """(target, topic, started_at, ended_at, n, actors): sliding windows, a fifth of their length apart, that fill up.

    Items later than late_seconds behind the newest are dropped and bound the state. actors is an estimate within 5 %, so a
    hot topic's state stays small; there is no background rate, as a stream has no end to measure it by.
    """
    rows = as_items(items).filter("created_at is not null").withWatermark("created_at", f"{late_seconds} seconds")
    topic = F.when(F.col("topic") == "", F.lit("__all__")).otherwise(F.col("topic"))
    window = F.window("created_at", f"{window_seconds} seconds", f"{max(1, window_seconds // 5)} seconds")
    counts = rows.groupBy(window.alias("w"), topic.alias("topic")).agg(F.count("*").alias("n"), F.approx_count_distinct("actor_id").alias("actors"))
    target = F.concat(F.lit("burst:"), F.col("topic"), F.lit(":"), isoformat(F.col("w.start")))
    return counts.filter((F.col("n") >= min_items) & (F.col("actors") >= min_actors)).select(target.alias("target"), "topic", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n", "actors")
