"""Evaluation against labels: confusion, purity of groups, levels, and ablations of layers."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.session import written
from murmuration.operators.hits import ACTOR, GROUP, ITEM
from murmuration.plans.pipeline import Pipeline
from murmuration.plans.scoring import flagged, rank_of
from murmuration.sources.dataset import Dataset
from murmuration.sources.fieldmap import Adapter, dig, optional
from murmuration.sources.records import read_jsonl

LAYERS = ("text", "account", "coordination")
ABLATIONS = (("all", LAYERS), *((x, (x,)) for x in LAYERS), ("text+account", LAYERS[:2]), ("text+coordination", (LAYERS[0], LAYERS[2])), ("account+coordination", LAYERS[1:]))


def load_labelled(spark: SparkSession, path: str, positive_prefix: str = "fake-") -> tuple[Dataset, DataFrame, DataFrame]:
    """The dataset of a labelled file, labels of items (by is_synthetic_positive) and of actors (by their ids' prefix)."""
    records = read_jsonl(spark, path)
    text = lambda path: F.try_variant_get(dig(F.col("record"), path), "$", "string")
    positive = F.try_variant_get("record", "$.is_synthetic_positive", "boolean")
    items = records.select(text("item_id").alias("target"), positive.alias("positive")).filter("target is not null and positive is not null")
    items = items.groupBy("target").agg(F.max("positive").alias("positive"))
    actors = records.select(optional(text("actor_id")).alias("target")).filter("target is not null").groupBy("target").agg(F.max(F.col("target").startswith(positive_prefix)).alias("positive"))
    return Adapter().load(spark, records), items, actors


def prf(tp: int, fp: int, fn: int) -> tuple[float, float, float]:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def confusion(assessments: DataFrame, labels: DataFrame, target_kind: str, least: str = "weak") -> DataFrame:
    """One row tp, fp, fn, tn of targets of a kind at a level; targets without a label are negative."""
    said = rank_of(F.col("level")) >= {"clean": 0, "weak": 1, "strong": 2}[least]
    rows = assessments.filter(F.col("target_kind") == target_kind).join(labels.select("target", "positive"), "target", "left")
    gold = F.coalesce("positive", F.lit(False))
    return rows.agg(F.count_if(gold & said).alias("tp"), F.count_if(~gold & said).alias("fp"), F.count_if(gold & ~said).alias("fn"), F.count_if(~gold & ~said).alias("tn"))


def evaluate_level(assessments: DataFrame, labels: DataFrame, target_kind: str, least: str = "weak") -> dict[str, Any]:
    row = confusion(assessments, labels, target_kind, least).first().asDict()
    p, r, f = prf(row["tp"], row["fp"], row["fn"])
    return row | {"precision": round(p, 4), "recall": round(r, 4), "f1": round(f, 4)}


def group_purity(assessments: DataFrame, actor_labels: DataFrame) -> DataFrame:
    """(signal, target, size, fake, purity): the share of labelled actors among the members that each hit of a flagged group shows."""
    hits = flagged(assessments).filter(F.col("target_kind") == GROUP).select("target", F.explode("hits").alias("h"))
    members = hits.select(F.col("target"), F.col("h.signal").alias("signal"), F.explode("h.members").alias("member"))
    joined = members.join(actor_labels.select(F.col("target").alias("member"), "positive"), "member", "left")
    counts = joined.groupBy("signal", "target").agg(F.count("*").alias("size"), F.count_if(F.coalesce("positive", F.lit(False))).alias("fake"))
    return counts.withColumn("purity", F.col("fake") / F.col("size"))


def level_distribution(assessments: DataFrame) -> dict[str, int]:
    found = {r.level: r["count"] for r in assessments.groupBy("level").count().collect()}
    return {k: found.get(k, 0) for k in ("clean", "weak", "strong")}


def ablations(data: Dataset, item_labels: DataFrame, actor_labels: DataFrame, cfg: Config | None = None, least: str = "weak", sets: tuple = ABLATIONS) -> list[dict[str, Any]]:
    """Metrics of each set of layers, by default all seven. Hits are found once; each set filters them and scores them anew."""
    base = Pipeline(cfg or Config.default())
    hits = written(base.hits(data), "hits")
    targets = written(base.targets(data), "targets")
    rows = []
    for name, layers in sets:
        began = time.perf_counter()
        off = [f"signals.{s.name}.enabled=false" for s in base.signals if s.kind not in layers]
        _, found = base.score(hits.filter(F.col("kind").isin(*layers)), targets, None)
        found = written(found, "assessments")
        rows.append({
            "name": name, "signals": sum(s.kind in layers for s in base.signals), "item": evaluate_level(found, item_labels, ITEM, least), "actor": evaluate_level(found, actor_labels, ACTOR, least),
            "groups": [r.asDict() for r in group_purity(found, actor_labels).orderBy("target").collect()], "levels": level_distribution(found),
            "latency_ms": round((time.perf_counter() - began) * 1000, 1), "fingerprint": base.cfg.with_overrides(*off).fingerprint(),
        })
    return rows


def render_markdown(rows: list[dict[str, Any]], title: str = "Benchmark") -> str:
    out = [f"# {title}", "", "| layers | signals | item P / R / F1 | actor P / R / F1 | clean / weak / strong | groups | mean purity | ms |", "|---|---|---|---|---|---|---|---|"]
    for r in rows:
        metric = lambda m: f"{m['precision']:.3f} / {m['recall']:.3f} / {m['f1']:.3f}"
        purity = sum(g["purity"] for g in r["groups"]) / len(r["groups"]) if r["groups"] else 0.0
        out.append(f"| {r['name']} | {r['signals']} | {metric(r['item'])} | {metric(r['actor'])} | {' / '.join(str(r['levels'][k]) for k in ('clean', 'weak', 'strong'))} | {len(r['groups'])} | {purity:.3f} | {r['latency_ms']} |")
    return "\n".join(out) + "\n"
