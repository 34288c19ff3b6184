"""Scans of texts for a rule book's phrases and expressions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmuration.functions.text import fold, let
from murmuration.sources.rules import RuleBook

MATCH = "array<struct<pattern:string,tag:string>>"


def scan_phrases(text: Column, rules: RuleBook) -> Column:
    """The distinct phrases in a text, small or capital letters alike: array<struct<pattern, tag>>."""
    if not rules.patterns:
        return F.array().cast(MATCH)
    one = lambda low, p, t: F.when(F.contains(low, F.lit(p)), F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("tag")))
    # a text is lower-cased once, and folded once, however many phrases look into it
    return let(F.lower(text), lambda low: F.array_compact(F.array(*[one(low, p, t) for p, t in rules.patterns])))


def scan_folded(text: Column, rules: RuleBook) -> Column:
    """The distinct phrases in the folded text."""
    return scan_phrases(fold(text, rules.fold_map), rules)


def scan_expressions(text: Column, rules: RuleBook) -> Column:
    """The first match of each expression that has one: array<struct<pattern, tag>>, pattern being the matched text."""
    found = []
    for e in rules.expressions:
        pattern = "(?U)" + e.pattern
        sample = F.regexp_extract(text, f"({pattern})", 1)
        found.append(F.when(text.rlike(pattern), F.struct(sample.alias("pattern"), F.lit(e.tag).alias("tag"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast(MATCH)


def find_all(text: Column, rules: RuleBook) -> Column:
    """Every occurrence of every phrase, overlapping ones too: array<struct<end, start, pattern, tag>> by end, positions half-open."""
    low = F.lower(text)
    kind = "array<struct<end:int,start:int,pattern:string,tag:string>>"

    def places(pattern: str, tag: str) -> Column:
        # cut before each occurrence, overlapping ones too; positions are the lengths so far
        parts = F.split(low, r"(?=\Q" + pattern + r"\E)", -1)

        def step(acc: Column, part: Column) -> Column:
            one = F.struct((acc["at"] + len(pattern)).alias("end"), acc["at"].alias("start"), F.lit(pattern).alias("pattern"), F.lit(tag).alias("tag"))
            return F.struct((acc["at"] + F.length(part)).alias("at"), F.when(F.startswith(part, F.lit(pattern[:1])) & F.contains(F.substring(low, acc["at"] + 1, len(pattern)), F.lit(pattern)), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        rows = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
        return F.when(F.contains(low, F.lit(pattern)), rows).otherwise(F.array().cast(kind))

    return F.array_sort(F.concat(*[places(p, t) for p, t in rules.patterns])) if rules.patterns else F.array().cast(kind)
