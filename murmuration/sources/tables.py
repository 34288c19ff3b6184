"""The driver's Parquet tables as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.sources.dataset import Dataset, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(name: str):
    return F.col(name).cast("string")


def documents(spark: SparkSession, folder: str) -> Dataset:
    """A document is an item of its source; its language is the topic."""
    d = table(spark, folder, "documents")
    items = d.select(F.col("doc_id").alias("seq"), text("doc_id").alias("item_id"), text("source").alias("actor_id"), "text", text("lang").alias("topic"))
    return Dataset.of(spread(items), source="documents")


def conversations(spark: SparkSession, folder: str) -> Dataset:
    """A turn is an item of its role in the topic of its conversation."""
    d = table(spark, folder, "conversations")
    ident = F.concat_ws("-", text("conv_id"), text("turn"))
    return Dataset.of(d.select((F.col("conv_id") * 10000 + F.col("turn")).alias("seq"), ident.alias("item_id"), text("role").alias("actor_id"), "text", text("conv_id").alias("topic")), source="conversations")


def events(spark: SparkSession, folder: str) -> Dataset:
    """An event is an item of its user in the topic of its type."""
    d = table(spark, folder, "events")
    items = d.select(F.col("event_id").alias("seq"), text("event_id").alias("item_id"), text("user_id").alias("actor_id"), text("event_type").alias("text"), F.col("ts").cast("timestamp").alias("created_at"), text("event_type").alias("topic"))
    return Dataset.of(items, source="events")


def daily_events(spark: SparkSession, folder: str) -> Dataset:
    """Events whose topic is their day and type."""
    d = events(spark, folder)
    return Dataset(d.items.withColumn("topic", F.concat_ws(" ", F.date_format("created_at", "yyyy-MM-dd"), F.col("topic"))), d.actors, "daily events")


def orders(spark: SparkSession, folder: str) -> Dataset:
    """Customers are actors since their first order; whole balances stand for followers and followed ones."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    items = o.select(F.col("o_orderkey").alias("seq"), text("o_orderkey").alias("item_id"), text("o_custkey").alias("actor_id"), text("o_orderpriority").alias("text"), F.col("o_orderdate").cast("timestamp").alias("created_at"), text("o_orderpriority").alias("topic"))
    first = o.groupBy(text("o_custkey").alias("actor_id")).agg(F.min("o_orderdate").cast("timestamp").alias("created_at"))
    people = c.select(
        text("c_custkey").alias("actor_id"), text("c_name").alias("name"), F.greatest(F.lit(0), F.floor(F.col("c_acctbal"))).cast("long").alias("following"), F.col("c_nationkey").cast("long").alias("followers"),
        (F.col("c_mktsegment") != "MACHINERY").alias("has_avatar"), (F.col("c_mktsegment") == "BUILDING").alias("is_default_name"),
    )
    return Dataset.of(items, people.join(first, "actor_id", "left"), "orders")


def supplied_parts(spark: SparkSession, folder: str) -> Dataset:
    """A line is an item of its supplier in the topic of its part."""
    d = table(spark, folder, "lineitem")
    items = d.select(text("l_suppkey").alias("actor_id"), text("l_partkey").alias("topic"))
    return Dataset.of(items, source="lineitem")
