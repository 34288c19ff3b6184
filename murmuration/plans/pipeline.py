"""The whole analysis: signals, two scoring passes with propagation between them, and what is known of the run."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.functions.text import preview
from murmuration.session import written
from murmuration.operators.hits import ACTOR, GROUP, HITS, ITEM, Context, Signal, build_signals
from murmuration.plans import report
from murmuration.plans.scoring import Scorer, flagged, propagate, ranked, settings
from murmuration.sources.dataset import Dataset
from murmuration.sources.rules import RuleBook


@dataclass
class Result:
    """Lazy tables of a run."""

    data: Dataset
    hits: DataFrame
    assessments: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    def flagged(self, least: str = "weak") -> DataFrame:
        return ranked(flagged(self.assessments, least))

    @property
    def summary(self) -> dict[str, Any]:
        return report.summarize(self.assessments)


class Pipeline:
    """Signals and rules may be given; else the settings choose them."""

    def __init__(self, cfg: Config | None = None, rules: RuleBook | None = None, signals: list[Signal] | None = None) -> None:
        self.cfg = cfg or Config.default()
        self.rules = rules if rules is not None else RuleBook.load(self.cfg.get("corpus.rules_dir") or None)
        self.signals = signals if signals is not None else build_signals(self.cfg)
        self.scorer = Scorer.of(self.cfg)

    @classmethod
    def from_config(cls, path: str | None = None, overrides: tuple[str, ...] = ()) -> Pipeline:
        return cls(Config.load(path, overrides))

    def hits_of(self, data: Dataset, signal: Signal) -> DataFrame:
        return signal.plan(Context(data, self.rules, self.cfg.signal_cfg(signal.name)))

    def hits(self, data: Dataset) -> DataFrame:
        empty = data.items.sparkSession.createDataFrame([], HITS)
        return reduce(DataFrame.unionByName, [self.hits_of(data, s) for s in self.signals], empty)

    def targets(self, data: Dataset) -> DataFrame:
        items = data.items.select(F.lit(ITEM).alias("target_kind"), F.col("item_id").alias("target"))
        return items.union(data.actors.select(F.lit(ACTOR), "actor_id")).distinct()

    def labels(self, data: Dataset, hits: DataFrame) -> DataFrame:
        """(target, label): previews of items, names of actors (over an item's of the same id), signal and topic of groups."""
        items = data.items.select(F.col("item_id").alias("target"), F.lit(1).alias("order"), preview(F.col("text")).alias("label"))
        actors = data.actors.select(F.col("actor_id").alias("target"), F.lit(0).alias("order"), F.when(F.col("name") != "", F.col("name")).otherwise(F.col("actor_id")).alias("label"))
        topic = F.get_json_object("evidence", "$.topic")
        groups = hits.filter(F.col("target_kind") == GROUP).select("target", F.lit(2).alias("order"), F.when(topic.isNotNull(), F.concat("signal", F.lit(" @ "), topic)).otherwise(F.col("target")).alias("label"))
        return items.union(actors).union(groups).groupBy("target").agg(F.min_by("label", "order").alias("label"))

    def score(self, hits: DataFrame, targets: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All hits with the propagated ones, and the assessments after both passes."""
        p = settings(self.cfg)
        if p.get("enabled", True):
            groups = self.scorer.assess(hits.filter(F.col("target_kind") == GROUP))
            hits = written(hits.unionByName(propagate(groups, float(p.get("factor", 0.6)))), "all-hits")
        return hits, self.scorer.assess(hits, targets, labels)

    def run(self, data: Dataset, profile: bool = False) -> Result:
        """Hits go through the shared folder; assessments stay lazy. profile: signals run one by one and are timed."""
        timings: dict[str, float] = {}
        if profile:
            parts = []
            for s in self.signals:
                began = time.perf_counter()
                parts.append(written(self.hits_of(data, s), "hits"))
                timings[s.name] = (time.perf_counter() - began) * 1000
            hits = reduce(DataFrame.unionByName, parts, data.items.sparkSession.createDataFrame([], HITS))
        else:
            hits = written(self.hits(data), "hits")
        hits, assessments = self.score(hits, self.targets(data), self.labels(data, hits))
        return Result(data, hits, assessments, self.meta(data), timings)

    def meta(self, data: Dataset) -> dict[str, Any]:
        n = data.items.agg(F.count("*"), F.count_distinct(data.topic_key())).first()
        return {"items": n[0], "actors": data.actors.count(), "topics": n[1], "source": data.source, "fingerprint": self.cfg.fingerprint(), "rules": self.rules.stats(), "signals": [s.name for s in self.signals]}
