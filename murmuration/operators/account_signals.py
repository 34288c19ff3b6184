"""Signals of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions import text as T
from murmuration.functions.scalars import age_days, clamp, follower_ratio
from murmuration.operators.hits import ACTOR, Context, make_hits, percent, register, strong_if

#: Two texts of an actor are copies from this Jaccard similarity of their character shingles on.
COPY = 0.6


def ages(actors: DataFrame, items: DataFrame) -> DataFrame:
    """actors with age in days at the last known time of an item, or now if there is none."""
    latest = items.agg(F.max("created_at")).scalar()
    return actors.withColumn("age", age_days(F.col("created_at"), F.coalesce(latest, F.current_timestamp())))


@register("account.age", ACTOR, "The account is young at the end of the data")
def age(c: Context) -> DataFrame:
    fresh, very_fresh = c.number("fresh_days", 30), c.number("very_fresh_days", 7)
    rows = ages(c.data.actors, c.data.items).filter(F.col("age") < fresh)
    reason = F.format_string("Registered %.0f days ago (needs other signals too)", F.col("age"))
    return make_hits(rows, "account.age", c.params, ACTOR, F.col("actor_id"), strong_if(F.col("age") <= very_fresh), clamp(1.0 - F.col("age") / fresh, 0.3, 1.0), reason, F.struct(F.round("age", 1).alias("age_days")))


def copy_pairs(sets: Column) -> Column:
    """struct<pairs, copies> of an array of distinct struct<s, n>: a set of shingles and the number of texts that have it; empty sets left out."""

    def of(full: Column) -> Column:
        n = F.aggregate(full, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        equal = F.aggregate(full, F.lit(0).cast("long"), lambda acc, x: acc + (x["n"] * (x["n"] - 1) / 2).cast("long"))
        # each set meets those after it; sets of sizes too different can't be copies
        like = lambda x, y: (F.least(F.size(x["s"]), F.size(y["s"])) >= COPY * F.greatest(F.size(x["s"]), F.size(y["s"]))) & (T.jaccard(x["s"], y["s"]) >= COPY)
        met = lambda x, i: F.aggregate(F.slice(full, i + 2, F.size(full)), F.lit(0).cast("long"), lambda acc, y: acc + F.when(like(x, y), x["n"] * y["n"]).otherwise(F.lit(0).cast("long")))
        alike = F.aggregate(F.transform(full, met), F.lit(0).cast("long"), lambda acc, x: acc + x)
        return F.struct((n * (n - 1) / 2).cast("long").alias("pairs"), (equal + alike).alias("copies"))

    return T.let(F.filter(sets, lambda x: F.size(x["s"]) > 0), of)


def copy_ratios(items: DataFrame, min_posts: int, max_posts: int) -> DataFrame:
    """(actor_id, posts, sampled, pairs, copies) of actors with min_posts items or more, over their first max_posts items.

    Texts of equal shingles are counted before they gather, and so are items beyond max_posts cut: an actor brings at most
    as many sets together as max_posts and its distinct texts allow.
    """
    order = Window.partitionBy("actor_id").orderBy("seq", "item_id")
    ranked = items.select("actor_id", "seq", "item_id", "text", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= max_posts)
    posts = items.groupBy("actor_id").agg(F.count("*").alias("posts")).filter(F.col("posts") >= min_posts)
    texts = ranked.groupBy("actor_id", "text").agg(F.count("*").alias("n"))
    counted = texts.select("actor_id", F.array_sort(T.shingles(F.col("text"))).alias("s"), "n").groupBy("actor_id", "s").agg(F.sum("n").alias("n"))
    sets = counted.groupBy("actor_id").agg(F.sum("n").alias("sampled"), F.collect_list(F.struct("s", "n")).alias("sets"))
    joined = posts.join(sets, "actor_id").withColumn("p", copy_pairs(F.col("sets")))
    return joined.select("actor_id", "posts", F.col("sampled").cast("int").alias("sampled"), "p.pairs", "p.copies")


@register("account.originality", ACTOR, "The account's own texts copy one another")
def originality(c: Context) -> DataFrame:
    threshold = c.number("copy_ratio", 0.6)
    rows = copy_ratios(c.data.items, c.whole("min_posts", 5), c.whole("max_posts", 60)).join(c.data.actors.select("actor_id"), "actor_id")
    rows = rows.filter("pairs > 0").withColumn("ratio", F.col("copies") / F.col("pairs")).filter(F.col("ratio") >= threshold)
    reason = F.concat(percent(F.col("ratio")), F.lit(" of the account's pairs of posts are near copies"))
    evidence = F.struct(F.round("ratio", 4).alias("copy_ratio"), "pairs", "sampled")
    return make_hits(rows, "account.originality", c.params, ACTOR, F.col("actor_id"), strong_if(F.col("ratio") >= threshold * 1.3), clamp(F.col("ratio") / max(threshold * 1.3, 1e-6), 0.4, 1.0), reason, evidence)


@register("account.profile", ACTOR, "Anomalies of the profile add up")
def profile(c: Context) -> DataFrame:
    ratio = follower_ratio(F.col("following"), F.col("followers"))
    features = [
        (F.col("is_default_name"), 0.3, F.lit("default name")),
        (~F.col("has_avatar"), 0.2, F.lit("no avatar")),
        (ratio >= c.number("follower_ratio", 5.0), 0.3, F.format_string("following/followers %.1f", ratio)),
        (F.coalesce(F.col("rename_count"), F.lit(0)) >= 5, 0.2, F.format_string("renamed %d times", F.col("rename_count"))),
    ]
    total: Column = F.lit(0.0)
    for condition, points, _ in features:
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    rows = c.data.actors.withColumn("total", total).filter(F.col("total") >= 0.4)
    names = F.array_compact(F.array(*[F.when(condition, name) for condition, _, name in features]))
    reason = F.concat(F.lit("Profile anomalies add up: "), F.array_join(names, ", "), F.lit(" (needs other signals too)"))
    evidence = F.struct(F.round("total", 2).alias("profile_score"), names.alias("features"))
    return make_hits(rows, "account.profile", c.params, ACTOR, F.col("actor_id"), strong_if(F.col("total") >= 0.6), clamp(F.col("total"), 0.3, 1.0), reason, evidence)
