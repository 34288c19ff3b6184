"""Items and actors of one analysis, as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEMS = "seq long, item_id string, actor_id string, text string, created_at timestamp, topic string, parent_id string, mentions array<string>, repost_of string, likes long"
ACTORS = "actor_id string, name string, created_at timestamp, followers long, following long, post_count long, has_avatar boolean, is_default_name boolean, rename_count int, verified boolean"
ALL_TOPICS = "__all__"


def _shaped(df: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    columns = []
    for field in schema.split(", "):
        name, kind = field.split(" ", 1)
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        columns.append((F.coalesce(c, defaults[name].cast(kind)) if name in defaults else c).alias(name))
    return df.select(*columns)


def as_items(df: DataFrame) -> DataFrame:
    """df with the columns of ITEMS; missing ones get defaults. seq orders the input and is needed where order counts."""
    return _shaped(df, ITEMS, {"topic": F.lit(""), "text": F.lit(""), "likes": F.lit(0), "mentions": F.array()})


def as_actors(df: DataFrame) -> DataFrame:
    zeros = {k: F.lit(0) for k in ("followers", "following", "post_count")}
    flags = {"has_avatar": F.lit(True), "is_default_name": F.lit(False), "verified": F.lit(False)}
    return _shaped(df, ACTORS, zeros | flags | {"name": F.lit("")})


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it has fewer partitions than they are: an input of few splits keeps few of them busy.

    Inputs with as many splits as cores don't move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class Dataset:
    items: DataFrame
    actors: DataFrame
    source: str = "records"

    @classmethod
    def of(cls, items: DataFrame, actors: DataFrame | None = None, source: str = "records") -> Dataset:
        """Tables with some of the columns; without actors there is one of each actor_id in items."""
        items = as_items(items)
        if actors is None:
            actors = items.filter("actor_id <> 'unknown'").select("actor_id").distinct()
        return cls(items, as_actors(actors), source)

    def topic_key(self) -> Column:
        return F.when(F.col("topic") == "", F.lit(ALL_TOPICS)).otherwise(F.col("topic"))

    def by_topic(self) -> DataFrame:
        """(topic, items); no topic counts as one of its own."""
        return self.items.groupBy(self.topic_key().alias("topic")).agg(F.count("*").alias("items"))

    def by_actor(self) -> DataFrame:
        return self.items.groupBy("actor_id").agg(F.count("*").alias("items"))

    def time_span(self) -> DataFrame:
        """One row: first and last known time of an item."""
        return self.items.agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
