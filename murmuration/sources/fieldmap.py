"""Field maps: dotted paths that project raw records to items and actors."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.scalars import epoch, optional, parse_time, to_int
from murmuration.functions.text import strip
from murmuration.sources.dataset import Dataset, spread
from murmuration.sources.records import from_dicts, read_jsonl
from murmuration.session import written

UNKNOWN = "unknown"


def dig(record: Column, path: str) -> Column:
    """The variant at a dotted path; a number is a list's index (negative from its end) or a key. Null if there is none."""
    at = record if path else F.lit(None).cast("variant")
    for part in path.split("."):
        key = "$['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"
        found = F.try_variant_get(at, key, "variant")
        if part.lstrip("-").isdigit():
            i = int(part)
            listed = F.try_variant_get(at, "$", "array<variant>")
            found = F.coalesce(F.try_element_at(listed, F.lit(i + 1 if i >= 0 else i)), found)
        at = found
    return at


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def truth(v: Column, missing: bool) -> Column:
    """Python's truth of a value: null, 0, false, '' and empty lists and objects are false."""
    kind, text = kind_of(v), as_string(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "MISSING", F.lit(missing)).when(kind == "VOID", F.lit(False)).when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.startswith("ARRAY"), ~kind.startswith("ARRAY<VOID>") | (F.size(F.try_variant_get(v, "$", "array<variant>")) > 0))
        .when(kind.startswith("OBJECT"), kind != "OBJECT<>").otherwise(number != 0)
    )


def time_of(v: Column) -> Column:
    kind = kind_of(v)
    return F.when(kind == "STRING", parse_time(as_string(v))).when(~kind.isin("BOOLEAN", "VOID", "MISSING") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), epoch(F.try_variant_get(v, "$", "double")))


def int_of(v: Column) -> Column:
    """Python's int of a value, 0 where it raises."""
    kind = kind_of(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(F.when(kind == "STRING", to_int(as_string(v))).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long")).when(F.abs(number) < 9.2e18, number.cast("long")), F.lit(0).cast("long"))


@dataclass(frozen=True)
class FieldMap:
    """Where records hold what; the defaults are the canonical record's keys."""

    item_id: str = "item_id"
    text: str = "text"
    actor_id: str = "actor_id"
    created_at: str = "created_at"
    topic: str = "topic"
    parent_id: str = "parent_id"
    mentions: str = "mentions"
    repost_of: str = "repost_of"
    likes: str = "likes"
    actor_name: str = "actor_name"
    actor_created_at: str = "actor_created_at"
    actor_followers: str = "actor_followers"
    actor_following: str = "actor_following"
    actor_posts: str = "actor_posts"
    actor_has_avatar: str = "actor_has_avatar"
    actor_default_name: str = "actor_default_name"
    actor_verified: str = "actor_verified"

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> FieldMap:
        """Unknown keys and values that aren't texts are ignored."""
        paths = ((f.name, raw.get(f.name)) for f in fields(cls))
        return replace(cls(), **{name: path for name, path in paths if isinstance(path, str)})


def fallback_id(topic: Column, text: Column, seq: Column) -> Column:
    """A stable id of 12 hex digits from topic, text and place, by blake2b in Arrow batches."""
    @F.pandas_udf("string")
    def run(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: "auto-" + hashlib.blake2b(b.encode(), digest_size=6).hexdigest())

    return run(F.concat_ws("|", F.coalesce(topic, F.lit("")), F.coalesce(text, F.lit("")), seq.cast("string")))


@dataclass(frozen=True)
class Adapter:
    """Loads records into a Dataset by a field map. The dataset's source is the name, with the number of skipped records
    unless told is false."""

    field_map: FieldMap = FieldMap()
    name: str = "mapped"
    told: bool = True

    def load(self, spark: SparkSession, source: Any) -> Dataset:
        """source: the path of a JSON-lines file, records in memory, or a table (seq, record variant)."""
        if isinstance(source, DataFrame):
            records = source
        else:
            records = read_jsonl(spark, source) if isinstance(source, str) else from_dicts(spark, source)
        # records are parsed once: every signal reads the projected tables
        skipped = self.skipped(records).first()["skipped"] if self.told else 0
        label = f"{self.name}(skipped={skipped})" if skipped else self.name
        return Dataset(written(spread(self.items(records)), "items"), written(self.actors(records), "actors"), label)

    def valid(self, records: DataFrame) -> DataFrame:
        """Records that are objects and whose text is a text that isn't blank."""
        text = dig(F.col("record"), self.field_map.text)
        return records.filter(F.coalesce((kind_of(text) == "STRING") & (strip(as_string(text)) != ""), F.lit(False)))

    def skipped(self, records: DataFrame) -> DataFrame:
        """One row: how many records were read and how many of them are left out."""
        text = dig(F.col("record"), self.field_map.text)
        good = F.coalesce((kind_of(text) == "STRING") & (strip(as_string(text)) != ""), F.lit(False))
        return records.agg(F.count("*").alias("records"), F.count_if(~good).alias("skipped"))

    def items(self, records: DataFrame) -> DataFrame:
        m, r = self.field_map, F.col("record")
        mentions = dig(r, m.mentions)
        listed = F.transform(F.try_variant_get(mentions, "$", "array<variant>"), as_string)
        none = F.array().cast("array<string>")
        actor, topic = as_string(dig(r, m.actor_id)), dig(r, m.topic)
        own = optional(as_string(dig(r, m.item_id)))
        return self.valid(records).select(
            F.col("seq").cast("long").alias("seq"),
            F.coalesce(own, fallback_id(as_string(dig(r, "topic")), as_string(dig(r, "text")), F.col("seq"))).alias("item_id"),
            F.coalesce(optional(actor), F.lit(UNKNOWN)).alias("actor_id"),
            strip(as_string(dig(r, m.text))).alias("text"),
            time_of(dig(r, m.created_at)).alias("created_at"),
            F.when(truth(topic, False), as_string(topic)).otherwise(F.lit("")).alias("topic"),
            optional(as_string(dig(r, m.parent_id))).alias("parent_id"),
            F.when(kind_of(mentions) == "STRING", F.when(as_string(mentions) == "", none).otherwise(F.array(as_string(mentions)))).otherwise(F.coalesce(listed, none)).alias("mentions"),
            optional(as_string(dig(r, m.repost_of))).alias("repost_of"),
            int_of(dig(r, m.likes)).alias("likes"),
        )

    def actors(self, records: DataFrame) -> DataFrame:
        """The first record of each actor_id; records without one give no actor."""
        m, r = self.field_map, F.col("record")
        rows = self.valid(records).select(
            F.col("seq").cast("long").alias("seq"),
            optional(as_string(dig(r, m.actor_id))).alias("actor_id"),
            F.coalesce(as_string(dig(r, m.actor_name)), F.lit("")).alias("name"),
            time_of(dig(r, m.actor_created_at)).alias("created_at"),
            int_of(dig(r, m.actor_followers)).alias("followers"),
            int_of(dig(r, m.actor_following)).alias("following"),
            int_of(dig(r, m.actor_posts)).alias("post_count"),
            truth(dig(r, m.actor_has_avatar), True).alias("has_avatar"),
            truth(dig(r, m.actor_default_name), False).alias("is_default_name"),
            F.lit(None).cast("int").alias("rename_count"),
            truth(dig(r, m.actor_verified), False).alias("verified"),
        ).filter("actor_id is not null")
        return first_of_actor(rows)


def first_of_actor(rows: DataFrame) -> DataFrame:
    """The row of least seq of each actor_id, without seq; rows fold before they move."""
    rest = [c for c in rows.columns if c not in ("actor_id", "seq")]
    return rows.groupBy("actor_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("actor_id", "r.*")
