"""Presets for platform exports: nested and flat comment JSON, and danmaku XML."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.text import BLANKS
from murmuration.session import new_path
from murmuration.sources.dataset import Dataset
from murmuration.sources.fieldmap import UNKNOWN, Adapter, FieldMap
from murmuration.sources.records import with_order

NESTED_COMMENTS = FieldMap(item_id="rpid", text="content.message", actor_id="member.mid", actor_name="member.uname", created_at="ctime", topic="oid", parent_id="parent", likes="like")
FLAT_COMMENTS = FieldMap(item_id="cid", text="text", actor_id="user.uid", actor_name="user.nickname", created_at="create_time", topic="aweme_id", likes="digg_count", parent_id="reply_id")


def nested_comments() -> Adapter:
    return Adapter(NESTED_COMMENTS, "bilibili", told=False)


def flat_comments() -> Adapter:
    return Adapter(FLAT_COMMENTS)


def read_danmaku(spark: SparkSession, source: str, topic: str = "") -> DataFrame:
    """(seq, item_id, text, actor_id, created_at, topic, likes) of the <d p="..."> nodes with seven parts or more and a text.

    source: a path, or the XML itself. item_id counts all nodes; an empty user is unknown.
    """
    path = source
    if "<" in source:
        # raw XML is small: it goes through a file of the shared folder
        path = new_path(spark, "danmaku")
        spark.createDataFrame([(source,)], "value string").coalesce(1).write.text(path)
    nodes = spark.read.schema("_p string, _VALUE string").format("xml").option("rowTag", "d").load(path)
    rows = with_order(nodes).withColumn("parts", F.split("_p", ","))
    stem = F.regexp_extract(F.lit(path), r"([^/]+?)(\.[^./]*)?$", 1) if "<" not in source else F.lit("")
    seconds = F.get("parts", F.lit(4)).try_cast("double")
    return rows.filter((F.size("parts") >= 7) & (F.trim(F.coalesce("_VALUE", F.lit(""))) != "")).select(
        "seq",
        F.concat(F.lit("dm-"), F.col("seq").cast("string")).alias("item_id"),
        F.btrim("_VALUE", F.lit(BLANKS)).alias("text"),
        F.coalesce(F.when(F.get("parts", F.lit(6)) != "", F.get("parts", F.lit(6))), F.lit(UNKNOWN)).alias("actor_id"),
        F.timestamp_micros((seconds * 1e6).cast("long")).alias("created_at"),
        (F.lit(topic) if topic else stem).alias("topic"),
        F.lit(0).cast("long").alias("likes"),
    )


def load_danmaku(spark: SparkSession, source: str, topic: str = "") -> Dataset:
    return Dataset.of(read_danmaku(spark, source, topic), source="bilibili:danmaku")


def normalise_replies(payload: DataFrame, topic: str = "") -> DataFrame:
    """Canonical records of a comment page (column record): exploded data.replies with a message and a user; a non-zero code raises."""
    code = F.try_variant_get("record", "$.code", "long")
    checked = payload.select(F.when(F.coalesce(code, F.lit(0)) != 0, F.raise_error(F.concat(F.lit("the platform says "), F.to_json("record")))).otherwise(F.lit(0)).alias("ok"), F.explode(F.try_variant_get("record", "$.data.replies", "array<variant>")).alias("r"))
    get = lambda path, kind="string": F.try_variant_get("r", path, kind)
    rows = checked.filter("ok = 0").select(
        get("$.rpid").alias("item_id"), F.trim(get("$.content.message")).alias("text"), get("$.member.mid").alias("actor_id"), get("$.member.uname").alias("actor_name"),
        F.timestamp_seconds(get("$.ctime", "long")).alias("created_at"), F.lit(topic).alias("topic"), F.coalesce(get("$.like", "long"), F.lit(0)).alias("likes"),
    )
    return rows.filter("text <> '' and actor_id is not null")


def any_adapter(name: str, **paths: Any) -> Adapter:
    """An adapter by name (canonical, nested, flat), with paths replaced."""
    base = {"canonical": Adapter(), "nested": nested_comments(), "flat": flat_comments()}[name]
    return replace(base, field_map=FieldMap.from_dict({**base.field_map.__dict__, **paths}))
