"""Signals of single items' texts. Each is one narrow projection: nothing moves between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions import bigrams as B
from murmuration.functions import text as T
from murmuration.functions.matching import scan_expressions, scan_folded, scan_phrases
from murmuration.functions.scalars import clamp
from murmuration.operators.hits import ITEM, Context, make_hits, percent, register, strong_if


def repeated_phrases(toks: Column, n: int, most: int = 3) -> Column:
    """The most frequent n-grams that occur twice or more, joined; of even ones the first seen."""
    g = T.grams(toks, n)
    rows = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("phrase"), i.alias("at"))))
    best = "array<struct<n:int,at:int,phrase:string>>"

    def kept(acc: Column) -> Column:
        one = F.array(F.struct((-acc["run"]).alias("n"), acc["first"].alias("at"), acc["last"].alias("phrase")))
        return F.when(acc["run"] > 1, F.slice(F.array_sort(F.concat(acc["best"], one)), 1, most)).otherwise(acc["best"])

    def step(acc: Column, x: Column) -> Column:
        same = x["phrase"].eqNullSafe(acc["last"])
        return F.struct(x["phrase"].alias("last"), F.when(same, acc["first"]).otherwise(x["at"]).alias("first"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"), F.when(same, acc["best"]).otherwise(kept(acc)).alias("best"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("first"), F.lit(0).alias("run"), F.array().cast(best).alias("best"))
    return F.transform(F.aggregate(rows, start, step, kept), lambda x: x["phrase"])


@register("text.template", ITEM, "One text repeats the same n-grams")
def template(c: Context) -> DataFrame:
    n, weak, strong = c.whole("n", 3), c.number("weak", 0.22), c.number("strong", 0.42)
    rows = c.data.items.select("item_id", "text", B.repetition(F.col("text"), n, c.rules.stopwords).alias("m")).select("item_id", "text", F.col("m.n").alias("size"), "m.ratio")
    rows = rows.filter((F.col("size") >= c.whole("min_tokens", 12)) & (F.col("ratio") >= weak))
    # phrases are sought in the texts that repeat, and only where evidence is used
    phrases = repeated_phrases(T.tokens(F.col("text"), c.rules.stopwords), n)
    evidence = F.struct(F.round("ratio", 4).alias("repeat_ratio"), F.col("size").alias("tokens"), phrases.alias("repeated_phrases"))
    reason = F.concat(F.lit(f"Highly templated text ({n}-gram repetition "), percent(F.col("ratio")), F.lit(")"))
    return make_hits(rows, "text.template", c.params, ITEM, F.col("item_id"), strong_if(F.col("ratio") >= strong), clamp(F.col("ratio") / max(strong, 1e-6), 0.3, 1.0), reason, evidence)


def repeated_characters(text: Column) -> Column:
    """struct<size, top, run, ratio>: of the compact text its length, most frequent character, longest run and that character's share."""

    def measures(t: Column) -> Column:
        return T.let(T.top_char(t), lambda top: F.struct(F.length(t).alias("size"), top.alias("top"), T.max_run(t).alias("run"), F.coalesce(top["n"] / F.length(t), F.lit(0.0)).alias("ratio")))

    return T.let(T.compact(text), measures)


def repetition_measures(items: DataFrame) -> DataFrame:
    """items with their compact text's size, its most frequent character (top), that one's share (ratio) and the longest run of one character."""
    return items.withColumn("m", T.once(repeated_characters(F.col("text")), lambda m: m.isNotNull())).select(*items.columns, "m.*")


@register("text.repetition", ITEM, "One character fills a text or runs on")
def repetition(c: Context) -> DataFrame:
    weak, strong, run = c.number("char_ratio", 0.45), c.number("strong_ratio", 0.6), c.whole("run_length", 6)
    floods = lambda m: (m["size"] >= c.whole("min_chars", 10)) & ((m["ratio"] >= weak) | (m["ratio"] >= strong) | (m["run"] >= min(run, 2 * run)))
    rows = c.data.items.select("item_id", T.once(repeated_characters(F.col("text")), floods).alias("m")).select("item_id", "m.*")
    intensity = clamp(F.greatest(F.col("ratio") / max(strong, 1e-6), F.col("run") / max(2 * run, 1)), 0.3, 1.0)
    reason = F.concat(F.lit("Flooding: the character '"), F.col("top.char"), F.lit("' makes up "), percent(F.col("ratio")), F.lit(", the longest run is "), F.col("run").cast("string"))
    evidence = F.struct(F.round("ratio", 4).alias("char_ratio"), F.col("top.char").alias("top_char"), F.col("run").alias("max_run"))
    return make_hits(rows, "text.repetition", c.params, ITEM, F.col("item_id"), strong_if((F.col("ratio") >= strong) | (F.col("run") >= 2 * run)), intensity, reason, evidence)


@register("text.keyword", ITEM, "Phrases and expressions of the rule book")
def keyword(c: Context) -> DataFrame:
    found = F.concat(scan_phrases(F.col("text"), c.rules), scan_expressions(F.col("text"), c.rules))
    rows = c.data.items.select("item_id", T.once(found, lambda m: F.size(m) > 0).alias("found"))
    rows = rows.withColumn("tags", F.array_distinct(F.transform("found", lambda m: m["tag"])))
    tags = sorted({p.tag for p in c.rules.phrases} | {e.tag for e in c.rules.expressions})
    if not tags:
        weights = F.transform("tags", lambda t: F.lit(1.0))
    else:
        table = F.create_map(*[F.lit(x) for t in tags for x in (t, float(c.rules.weight(t)))])
        weights = F.transform("tags", lambda t: F.coalesce(F.try_element_at(table, t), F.lit(1.0)))
    bonus = F.least(F.lit(0.25), F.lit(0.08) * (F.size("tags") - 1))
    rows = rows.withColumn("intensity", clamp(F.array_max(weights) + bonus, 0.2, 1.0))
    strong_tags = c.params.get("strong_tags") or []
    strong = F.col("intensity") >= 0.9
    if strong_tags:
        strong = strong | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in strong_tags]))
    samples = lambda t: F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda m: m["tag"] == t), lambda m: m["pattern"])))
    evidence = F.map_from_arrays("tags", F.transform("tags", lambda t: F.slice(samples(t), 1, 5)))
    reason = F.concat(F.lit("Phrases or rules: "), F.array_join(F.transform("tags", lambda t: F.concat(t, F.lit("("), F.size(samples(t)).cast("string"), F.lit(")"))), ", "))
    return make_hits(rows, "text.keyword", c.params, ITEM, F.col("item_id"), strong_if(strong), F.col("intensity"), reason, evidence)


@register("text.evasion", ITEM, "Phrases that show only once variants and signs are folded")
def evasion(c: Context) -> DataFrame:
    names = lambda found: F.transform(found, lambda m: m["pattern"])
    both = F.struct(names(scan_phrases(F.col("text"), c.rules)).alias("direct"), names(scan_folded(F.col("text"), c.rules)).alias("folded"))
    found = T.let(both, lambda m: F.struct(m["direct"].alias("direct"), F.array_sort(F.array_except(m["folded"], m["direct"])).alias("extra")))
    rows = c.data.items.select("item_id", T.once(found, lambda m: F.size(m["extra"]) >= max(1, c.whole("min_extra", 1))).alias("m")).select("item_id", "m.*")
    reason = F.concat(F.lit("Deliberate evasion: "), F.array_join(F.slice("extra", 1, 5), ", "))
    evidence = F.struct(F.col("extra").alias("evaded"), F.array_sort("direct").alias("direct"))
    return make_hits(rows, "text.evasion", c.params, ITEM, F.col("item_id"), F.lit("strong"), clamp(0.7 + 0.1 * (F.size("extra") - 1), 0.7, 1.0), reason, evidence)
