"""Scores: hits become an assessment of each target, and flagged groups pass part of theirs to their members."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.operators.hits import ACTOR, CLEAN, COORDINATION, GROUP, STRONG, WEAK

MEMBER = "#member"


def rank_of(level: Column) -> Column:
    return F.when(level == STRONG, 2).when(level == WEAK, 1).otherwise(0)


def lookup(key: Column, table: dict[str, float]) -> Column:
    """A weight by name, 1 for names that aren't there."""
    out = F.lit(1.0)
    for name, value in table.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


@dataclass(frozen=True)
class Scorer:
    kind_weights: dict[str, float]
    level_multiplier: dict[str, float]
    min_kinds: int = 2
    bonus_per_extra: float = 8.0
    weak: float = 20.0
    strong: float = 50.0
    scale: float = 25.0
    cap: float = 100.0

    @classmethod
    def of(cls, cfg: Config) -> Scorer:
        s = cfg.section("scoring")
        synergy, levels = s.get("synergy") or {}, s.get("levels") or {}
        numbers = lambda d: {str(k): float(v) for k, v in (d or {}).items()}
        return cls(numbers(s.get("kind_weights")), numbers(s.get("level_multiplier")), int(synergy.get("min_kinds", 2)), float(synergy.get("bonus_per_extra", 8.0)), float(levels.get("weak", 20)), float(levels.get("strong", 50)), float(s.get("scale", 25.0)), float(s.get("cap", 100)))

    def contribution(self) -> Column:
        return F.col("score") * lookup(F.col("level"), self.level_multiplier) * F.col("weight") * lookup(F.col("kind"), self.kind_weights)

    def level_of(self, score: Column) -> Column:
        return F.when(score >= self.strong, F.lit(STRONG)).when(score >= self.weak, F.lit(WEAK)).otherwise(F.lit(CLEAN))

    def totals(self, hits: DataFrame) -> DataFrame:
        """(target_kind, target, raw, kinds, any_strong, n_hits): sums that fold before they move, without the hits themselves."""
        return hits.withColumn("contribution", self.contribution()).groupBy("target_kind", "target").agg(F.sum("contribution").alias("raw"), F.count_distinct("kind").alias("kinds"), F.max(F.col("level") == STRONG).alias("any_strong"), F.count("*").alias("n_hits"))

    def judged(self, totals: DataFrame) -> DataFrame:
        """totals with bonus, exact score, level and promoted."""
        kinds, raw = F.coalesce("kinds", F.lit(0)), F.coalesce("raw", F.lit(0.0))
        bonus = F.when(kinds >= self.min_kinds, (kinds - self.min_kinds + 1) * self.bonus_per_extra).otherwise(F.lit(0.0))
        rows = totals.withColumn("bonus", bonus).withColumn("exact_score", F.least(raw * self.scale + F.col("bonus"), F.lit(self.cap)))
        by_score = self.level_of(F.col("exact_score"))
        promoted = (by_score == CLEAN) & F.coalesce("any_strong", F.lit(False))
        return rows.withColumn("promoted", promoted).withColumn("level", F.when(promoted, F.lit(WEAK)).otherwise(by_score))

    def levels(self, hits: DataFrame, targets: DataFrame) -> DataFrame:
        """(target_kind, target, exact_score, level, n_hits) as assess() gives them, without the hits: their texts aren't made, and sums fold before they move."""
        rows = targets.select("target_kind", "target").distinct().join(self.totals(hits), ["target_kind", "target"], "full")
        return self.judged(rows).select("target_kind", "target", "exact_score", "level", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))

    def assess(self, hits: DataFrame, targets: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
        """An assessment a target: target_kind, target, label, score, level, bonus, promoted, hits, breakdown, n_hits.

        targets (target_kind, target) appear even without hits; labels (target, label) are looked up by target. hits are
        sorted by score and signal; breakdown holds each one's contribution. No order: see ranked().
        """
        weighed = hits.withColumn("contribution", self.contribution())
        one = F.struct((-F.col("score")).alias("order"), "signal", "kind", "level", "score", "weight", "reason", "evidence", "members", (F.col("contribution") * self.scale).alias("points"))
        grouped = weighed.groupBy("target_kind", "target").agg(F.sum("contribution").alias("raw"), F.count_distinct("kind").alias("kinds"), F.max(F.col("level") == STRONG).alias("any_strong"), F.array_sort(F.collect_list(one)).alias("all"))
        if targets is not None:
            grouped = targets.select("target_kind", "target").distinct().join(grouped, ["target_kind", "target"], "full")
        rows = self.judged(grouped)
        if labels is not None:
            rows = rows.join(labels.select("target", F.col("label").alias("named")), "target", "left")
        none = F.array()
        kept = F.transform("all", lambda h: F.struct(*[h[x].alias(x) for x in ("signal", "kind", "level", "score", "weight", "reason", "evidence", "members")]))
        parts = F.transform("all", lambda h: F.struct(h["signal"].alias("signal"), h["points"].alias("contribution")))
        label = F.coalesce("named", F.lit("")) if labels is not None else F.lit("")
        return rows.select("target_kind", "target", label.alias("label"), F.round("exact_score", 2).alias("score"), "level", F.round("bonus", 2).alias("bonus"), "promoted", F.coalesce(kept, none).alias("hits"), F.coalesce(parts, none).alias("breakdown"), F.coalesce(F.size("all"), F.lit(0)).alias("n_hits"), "exact_score")


def flagged(assessments: DataFrame, least: str = WEAK) -> DataFrame:
    """Assessments of that level or above."""
    return assessments.filter(rank_of(F.col("level")) >= {CLEAN: 0, WEAK: 1, STRONG: 2}[least])


def ranked(assessments: DataFrame) -> DataFrame:
    return assessments.orderBy(F.desc("score"), "target", "target_kind")


def propagate(assessments: DataFrame, factor: float) -> DataFrame:
    """A hit for each member that each hit of a flagged group shows: part of its score, weak, under its signal's name + #member."""
    groups = flagged(assessments).filter(F.col("target_kind") == GROUP)
    rows = groups.select("target", "score", F.explode("hits").alias("h")).select("target", F.col("score").alias("group_score"), "h.*", F.explode("h.members").alias("member"))
    return rows.select(
        F.concat("signal", F.lit(MEMBER)).alias("signal"), F.lit(COORDINATION).alias("kind"), F.col("member").alias("target"), F.lit(ACTOR).alias("target_kind"), F.lit(WEAK).alias("level"), (F.col("score") * factor).alias("score"), "weight",
        F.format_string("In a suspicious group (%s, group score %.0f)", "signal", "group_score").alias("reason"), F.to_json(F.struct(F.col("target").alias("group"), "group_score", F.col("signal").alias("via"))).alias("evidence"), F.lit(None).cast("array<string>").alias("members"),
    )


def settings(cfg: Config) -> dict[str, Any]:
    return cfg.section("scoring").get("propagation") or {}
