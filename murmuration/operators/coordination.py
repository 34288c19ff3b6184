"""Signals of groups: bursts in time, clusters of texts, and communities of actors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions import bigrams as B
from murmuration.functions import text as T
from murmuration.functions.scalars import clamp, isoformat, micros
from murmuration.operators.graph import listed_communities, listed_density
from murmuration.operators.hits import GROUP, Context, make_hits, percent, register, strong_if
from murmuration.operators.kernels import anchors_udf, greedy_copies, shares_run_udf
from murmuration.operators.overlap import Overlaps
from murmuration.session import written
from murmuration.sources.dataset import Dataset

#: Members that a hit's evidence shows, and that it passes its score to unless max_members says otherwise (None: all).
SHOWN = 30


def passed_on(c: Context, actors: Column) -> Column:
    most = c.params.get("max_members", SHOWN)
    return actors if most is None else F.slice(actors, 1, int(most))


def trailing_counts(data: Dataset, window_seconds: float) -> DataFrame:
    """Timed items with n, the topic's items in the window_seconds up to theirs, and the first one's time (microseconds).

    Topics are cut into time buckets of the window's length, and each item also enters the next bucket as history, so a
    hot topic spreads over tasks.
    """
    size = max(1, int(window_seconds * 1e6))
    timed = data.items.filter("created_at is not null").select(data.topic_key().alias("topic"), "actor_id", micros(F.col("created_at")).alias("us"))
    bucket = F.floor(F.col("us") / size)
    copies = F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))))
    rows = timed.select("topic", "actor_id", "us", copies.alias("c")).select("topic", "actor_id", "us", "c.bucket", "c.own")
    frame = Window.partitionBy("topic", "bucket").orderBy("us").rangeBetween(-size, 0)
    return rows.select("topic", "actor_id", "us", "bucket", "own", F.count("*").over(frame).alias("n"), F.min("us").over(frame).alias("first_us")).filter("own").drop("own")


def best_windows(data: Dataset, window_seconds: float, min_items: int) -> DataFrame:
    """(topic, n, first_us, last_us): each topic's fullest window, the first of even ones, if it holds min_items."""
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col("us")).alias("late"), F.col("first_us")))
    rows = trailing_counts(data, window_seconds).groupBy("topic").agg(best.alias("b"))
    return rows.select("topic", "b.n", "b.first_us", (-F.col("b.late")).alias("last_us")).filter(F.col("n") >= min_items)


def bursts(data: Dataset, window_seconds: float, min_items: int, min_actors: int, density_ratio: float) -> DataFrame:
    """(topic, n, first_us, last_us, span, local_rate, background, ratio, actors) of topics that burst."""
    us = micros(F.col("created_at"))
    timed = data.items.filter("created_at is not null")
    total = timed.agg(F.count("*")).scalar()
    span = timed.agg((F.max(us) - F.min(us)) / 1e6).scalar()
    best = best_windows(data, window_seconds, min_items).withColumn("span", F.greatest((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(1.0)))
    best = best.withColumn("local_rate", F.col("n") / F.col("span")).withColumn("background", total / F.greatest(span, F.lit(1.0)))
    best = best.withColumn("ratio", F.col("local_rate") / F.col("background")).filter((F.col("ratio") >= density_ratio) & (total >= min_items))
    # the items of a window lie in two buckets, so topics meet by bucket and not by topic alone
    size = max(1, int(window_seconds * 1e6))
    spread = best.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first_us") / size), F.floor(F.col("last_us") / size))))
    events = timed.select(data.topic_key().alias("topic"), "actor_id", us.alias("us")).withColumn("bucket", F.floor(F.col("us") / size))
    inside = events.join(spread.select("topic", "bucket", "first_us", "last_us"), ["topic", "bucket"]).filter("us between first_us and last_us")
    actors = inside.groupBy("topic").agg(F.array_sort(F.collect_set("actor_id")).alias("actors")).filter(F.size("actors") >= min_actors)
    return best.join(actors, "topic")


@register("coordination.burst", GROUP, "A topic fills up in a short time, by several actors")
def burst(c: Context) -> DataFrame:
    least, ratio = c.whole("min_items", 8), c.number("density_ratio", 2.5)
    rows = bursts(c.data, c.number("window_seconds", 300), least, c.whole("min_actors", 3), ratio)
    target = F.concat(F.lit("burst:"), F.col("topic"), F.lit(":"), isoformat(F.timestamp_micros("first_us")))
    reason = F.format_string("'%s' had %d items in %.0f seconds (by %d actors, %.2f a second, %.1f times the background)", "topic", "n", "span", F.size("actors"), "local_rate", "ratio")
    shown = F.slice("actors", 1, SHOWN)
    evidence = F.struct("topic", F.col("n").alias("count"), F.round("span", 1).alias("span_seconds"), F.round("local_rate", 4).alias("local_rate"), F.round("background", 4).alias("background_rate"), F.round("ratio", 2).alias("density_ratio"), shown.alias("actors"), F.size("actors").alias("actor_count"))
    return make_hits(rows, "coordination.burst", c.params, GROUP, target, strong_if(F.col("n") >= 2 * least), clamp(0.5 + (F.col("ratio") - ratio) / max(ratio, 1e-6), 0.4, 1.0), reason, evidence, passed_on(c, F.col("actors")))


def cluster_candidates(data: Dataset, min_chars: int, max_per_topic: int | None) -> DataFrame:
    """(topic, rank, item_id, actor_id, text) of texts of min_chars or more, ranked by input order within their topic; to be
    written at once.

    max_per_topic: only the first ones of each topic (None: all, which are dealt out by range, whatever their topics).
    """
    rows = data.items.filter(F.length(T.strip(F.col("text"))) >= min_chars).withColumn("topic", data.topic_key())
    if max_per_topic is None:
        return rows.select("topic", "seq", "item_id", "actor_id", "text").orderBy("topic", "seq", "item_id").select("topic", F.monotonically_increasing_id().alias("rank"), "item_id", "actor_id", "text")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy("seq", "item_id")).cast("long")
    return rows.select("topic", rank.alias("rank"), "item_id", "actor_id", "text").filter(F.col("rank") <= max_per_topic)


def equal_texts(candidates: DataFrame) -> DataFrame:
    """(topic, rank, first, copies): the rank of the first candidate of the topic with the same text, and how many have it."""
    rows = candidates.select("topic", "rank", F.sha2("text", 256).alias("digest"))
    classes = rows.groupBy("topic", "digest").agg(F.min("rank").alias("first"), F.count("*").alias("copies"))
    return rows.join(classes, ["topic", "digest"]).select("topic", "rank", "first", "copies")


def similar_pairs(candidates: DataFrame, stopwords: frozenset[str], similarity: float, lcs_ratio: float) -> DataFrame:
    """(topic, i, j) of ranks i < j whose fingerprints are similar and whose texts share a long run, and (topic, i, i) of
    texts that would be so with a copy.

    Texts meet by topic and anchor, which texts with such a run share, and not by topic alone. The cheap bit count is part
    of the join; only pairs that pass it fetch their texts.
    """
    shown = ["topic", "rank", "print", F.length("text").alias("size")]
    prints = written(candidates.withColumn("print", B.simhash(F.col("text"), stopwords)).select(*shown, anchors_udf(F.col("text"), lcs_ratio).alias("anchors")), "prints")
    keyed = prints.select("topic", "rank", "print", "size", F.explode("anchors").alias("k")).select("topic", "rank", "print", "size", "k.scale", "k.hash")
    side = lambda x: keyed.select("topic", "scale", "hash", F.col("rank").alias(x), F.col("print").alias(f"print_{x}"), F.col("size").alias(f"size_{x}"))
    most = next(d for d in range(64, -1, -1) if 1 - d / 64 >= similarity) if similarity > 0 else 64
    near = (F.bit_count(F.col("print_i").bitwiseXOR(F.col("print_j"))) <= most) & ~((F.col("print_i") == 0) & (F.col("print_j") == 0)) if similarity > 0 else F.lit(True)
    # a run of lcs_ratio of the longer text must fit in the shorter one
    fits = F.least("size_i", "size_j") >= F.greatest("size_i", "size_j") * F.lit(lcs_ratio) - F.lit(1e-9)
    met = side("i").join(side("j"), ["topic", "scale", "hash"]).filter((F.col("i") < F.col("j")) & near & fits).select("topic", "i", "j").distinct()
    texts = lambda x: candidates.select("topic", F.col("rank").alias(x), F.col("text").alias(f"text_{x}"))
    pairs = met.join(texts("i"), ["topic", "i"]).join(texts("j"), ["topic", "j"])
    found = pairs.filter(shares_run_udf(F.col("text_i"), F.col("text_j"), lcs_ratio)).select("topic", "i", "j")
    alike = (F.col("size") > 0) & F.lit(lcs_ratio <= 1) & ((F.col("print") != 0) | F.lit(similarity <= 0))
    return found.union(prints.filter(alike).select("topic", F.col("rank").alias("i"), F.col("rank").alias("j")))


def clusters(data: Dataset, stopwords: frozenset[str], similarity: float, lcs_ratio: float, min_cluster: int, min_actors: int, min_chars: int, max_per_topic: int | None) -> DataFrame:
    """(topic, leader, size, actors, item_ids, sample) of clusters by a greedy pass in input order within each topic.

    Equal texts are compared once, by the first of them.
    """
    candidates = written(cluster_candidates(data, min_chars, max_per_topic), "candidates")
    copies = written(equal_texts(candidates), "copies")
    firsts = candidates.join(copies.filter("rank = first").select("topic", "rank"), ["topic", "rank"])
    pairs = similar_pairs(firsts, stopwords, similarity, lcs_ratio)
    alone = copies.filter("rank = first and copies = 1").select("topic", F.col("rank").alias("i"), F.col("rank").alias("j"))
    pairs = written(pairs.join(alone, ["topic", "i", "j"], "left_anti"), "pairs")
    linked = pairs.select("topic", F.explode(F.array("i", "j")).alias("first")).distinct()
    members = copies.join(linked, ["topic", "first"]).select("topic", "first", "rank")

    def run(links: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
        found = greedy_copies(list(zip(links["i"], links["j"])), list(zip(ranks["first"], ranks["rank"])), min_cluster)
        return pd.DataFrame({"topic": links["topic"].iloc[0] if len(links) else "", "leader": pd.Series([a for a, _ in found], dtype="int64"), "rank": pd.Series([b for _, b in found], dtype="int64")})

    taken = pairs.groupBy("topic").cogroup(members.groupBy("topic")).applyInPandas(run, "topic string, leader long, rank long")
    rows = taken.join(candidates, ["topic", "rank"]).groupBy("topic", "leader")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    rows = rows.agg(F.count("*").alias("size"), F.array_sort(F.collect_set("actor_id")).alias("actors"), F.transform(in_order, lambda x: x["item_id"]).alias("item_ids"), F.min_by("text", "rank").alias("sample"))
    return rows.filter(F.size("actors") >= min_actors)


@register("coordination.cluster", GROUP, "Texts of several actors copy one another")
def cluster(c: Context) -> DataFrame:
    least = c.whole("min_cluster", 3)
    most = c.params.get("max_per_topic", 400)
    rows = clusters(c.data, c.rules.stopwords, c.number("similarity", 0.72), c.number("lcs_ratio", 0.5), least, c.whole("min_actors", 3), c.whole("min_chars", 8), None if most is None else int(most))
    target = F.concat(F.lit("cluster:"), F.col("topic"), F.lit(":"), F.get("item_ids", F.lit(0)))
    shown = F.slice("actors", 1, SHOWN)
    reason = F.format_string("'%s' has %d texts that are much alike (by %d actors)", "topic", "size", F.size("actors"))
    evidence = F.struct("topic", "size", shown.alias("actors"), T.preview(F.col("sample")).alias("sample"), F.slice("item_ids", 1, SHOWN).alias("item_ids"))
    return make_hits(rows, "coordination.cluster", c.params, GROUP, target, strong_if(F.col("size") >= 2 * least), clamp(0.5 + 0.1 * F.col("size"), 0.5, 1.0), reason, evidence, passed_on(c, F.col("actors")))


def topic_pairs(data: Dataset) -> DataFrame:
    """(owner, element): distinct actors and named topics."""
    return data.items.filter("topic <> ''").select(F.col("actor_id").alias("owner"), F.col("topic").alias("element")).distinct()


@register("coordination.cooccur", GROUP, "Actors move in the same topics")
def cooccur(c: Context) -> DataFrame:
    least = c.whole("min_members", 3)
    met = Overlaps(topic_pairs(c.data), c.whole("min_shared", 3), c.number("overlap", 0.5), whole=True)
    member = written(listed_communities(written(met.neighbours(), "neighbours"), met.owners), "communities")
    lists = member.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("nodes")).filter(F.size("nodes") >= least)
    rows = lists.join(listed_density(member, True), "community")
    shown = F.slice("nodes", 1, SHOWN)
    reason = F.concat(F.col("size").cast("string"), F.lit(" actors move in the same topics (density "), percent(F.col("density")), F.lit(")"))
    evidence = F.struct(shown.alias("members"), F.col("size").alias("member_count"), F.round("density", 3).alias("density"))
    return make_hits(rows, "coordination.cooccur", c.params, GROUP, F.concat(F.lit("cooccur:"), F.col("community")), strong_if(F.col("size") >= 2 * least), clamp(0.4 + F.col("density"), 0.4, 1.0), reason, evidence, passed_on(c, F.col("nodes")))
