"""Reports of assessments: counts, JSON, plain text and Markdown. Only what is shown comes to the driver."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.plans.scoring import flagged, ranked

LEVEL_NAMES = {"clean": "clean", "weak": "weak suspicion", "strong": "strong suspicion"}
LAYERS = ("text", "account", "coordination")


def summary_counts(assessments: DataFrame) -> DataFrame:
    """One row of counts by level, of targets without any signal, and of flagged ones by kind."""
    level, kind = F.col("level"), F.col("target_kind")
    bad = level != "clean"
    return assessments.agg(
        F.count("*").alias("assessed"), F.count_if(F.col("n_hits") == 0).alias("no_signal"), *[F.count_if(level == x).alias(x) for x in ("clean", "weak", "strong")],
        F.count_if(bad).alias("flagged"), *[F.count_if(bad & (kind == k)).alias(f"flagged_{k}") for k in ("item", "actor", "group")],
    )


def signal_counts(assessments: DataFrame) -> DataFrame:
    """(signal, n) of the hits of flagged targets."""
    return flagged(assessments).select(F.explode("hits.signal").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def summarize(assessments: DataFrame) -> dict[str, Any]:
    row = summary_counts(assessments).first().asDict()
    by_kind = {k: row.pop(f"flagged_{k}") for k in ("item", "actor", "group")}
    top = signal_counts(assessments).orderBy(F.desc("n"), "signal").limit(5).collect()
    return row | {"flagged_by_kind": by_kind, "top_signals": [(r.signal, r.n) for r in top]}


def picked(assessments: DataFrame, limit: int | None, least: str | None = None) -> list[dict[str, Any]]:
    """The first assessments by score as dicts; limit None or 0: all."""
    rows = ranked(assessments if least is None else flagged(assessments, least))
    return [to_dict(r.asDict(recursive=True)) for r in (rows.limit(limit) if limit else rows).collect()]


def to_dict(row: dict[str, Any]) -> dict[str, Any]:
    hits = [{"signal": h["signal"], "kind": h["kind"], "level": h["level"], "score": round(h["score"], 4), "weight": h["weight"], "reason": h["reason"], "evidence": json.loads(h["evidence"] or "{}")} for h in row["hits"]]
    keep = ("target", "target_kind", "label", "level", "promoted")
    # rounded here, half to even, from what wasn't rounded before
    numbers = {"score": round(row["exact_score"], 2), "bonus": round(row["bonus"], 2)}
    parts = [{"signal": x["signal"], "contribution": round(x["contribution"], 2)} for x in row["breakdown"]]
    return {k: row[k] for k in keep} | numbers | {"level_label": LEVEL_NAMES[row["level"]], "hits": hits, "breakdown": parts}


def json_rows(assessments: DataFrame) -> DataFrame:
    """(value): a JSON object an assessment, for a distributed sink."""
    return assessments.drop("exact_score", "n_hits").select(F.to_json(F.struct("*")).alias("value"))


def render_json(assessments: DataFrame, indent: int = 2, limit: int | None = None) -> str:
    return json.dumps(picked(assessments, limit), ensure_ascii=False, indent=indent)


def _title(a: dict[str, Any]) -> str:
    return f"[{a['level_label']}] {a['score']:.1f} points"


def render_text(assessments: DataFrame, limit: int | None = 20, least: str | None = None, evidence: bool = False) -> str:
    blocks = []
    for a in picked(assessments, limit, least):
        note = "  <- below the threshold, raised by a strong signal" if a["promoted"] else ""
        lines = [f"-- {_title(a)}, {a['target_kind']}: {a['label'] or a['target']}{note}"]
        order = lambda h: (LAYERS.index(h["kind"]) if h["kind"] in LAYERS else len(LAYERS), -h["score"])
        for h in sorted(a["hits"], key=order):
            lines.append(f"   [{h['kind']}] {h['signal']:<24} {h['reason']}")
            if evidence and h["evidence"]:
                lines.append("          " + json.dumps(h["evidence"], ensure_ascii=False)[:240])
        if a["bonus"]:
            lines.append(f"   [+] several layers agree: +{a['bonus']:.1f} ({len({h['kind'] for h in a['hits']})} layers)")
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) or "No suspicious target reaches the threshold."


def _cell(x: Any) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def render_markdown(assessments: DataFrame, meta: dict[str, Any] | None = None, limit: int | None = 50) -> str:
    s = summarize(assessments)
    out = ["# Report", ""]
    if meta:
        out += ["| item | value |", "|---|---|", *[f"| {_cell(k)} | {_cell(v)} |" for k, v in meta.items()], ""]
    out += ["## Overview", "", f"- assessed: {s['assessed']} (clean {s['clean']}, weak {s['weak']}, strong {s['strong']})", f"- without any signal: {s['no_signal']} (not covered by a rule, which isn't the same as clean)"]
    out.append("- flagged: " + ", ".join(f"{k} {n}" for k, n in s["flagged_by_kind"].items()))
    if s["top_signals"]:
        out.append("- most frequent signals: " + ", ".join(f"`{k}` ({n})" for k, n in s["top_signals"]))
    out += ["", "## Targets", ""]
    for a in picked(assessments, limit):
        out += [f"### {_title(a)}: {_cell(a['label'] or a['target'])}", "", "| layer | signal | level | reason |", "|---|---|---|---|"]
        out += [f"| {h['kind']} | `{h['signal']}` | {LEVEL_NAMES[h['level']]} | {_cell(h['reason'])} |" for h in sorted(a["hits"], key=lambda h: -h["score"])]
        if a["bonus"]:
            out += ["", f"> several layers agree: **+{a['bonus']:.1f}**"]
        out.append("")
    return "\n".join(out)
