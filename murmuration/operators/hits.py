"""What signals yield: rows of evidence against a target, and the registry of signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.functions.scalars import clamp
from murmuration.sources.dataset import Dataset
from murmuration.sources.rules import RuleBook

HITS = "signal string, kind string, target string, target_kind string, level string, score double, weight double, reason string, evidence string, members array<string>"
CLEAN, WEAK, STRONG = "clean", "weak", "strong"
LEVELS = (CLEAN, WEAK, STRONG)
TEXT, ACCOUNT, COORDINATION = "text", "account", "coordination"
ITEM, ACTOR, GROUP = "item", "actor", "group"


@dataclass(frozen=True)
class Context:
    """What a signal may use."""

    data: Dataset
    rules: RuleBook
    params: dict[str, Any] = field(default_factory=dict)

    def number(self, name: str, default: float) -> float:
        return float(self.params.get(name, default))

    def whole(self, name: str, default: int) -> int:
        return int(self.params.get(name, default))


@dataclass(frozen=True)
class Signal:
    """A named query of a kind: plan(context) gives its hits."""

    name: str
    target_kind: str
    plan: Callable[[Context], DataFrame]
    description: str = ""

    @property
    def kind(self) -> str:
        return self.name.split(".")[0]

    def describe(self) -> dict[str, str]:
        return {"name": self.name, "kind": self.kind, "target_kind": self.target_kind, "description": self.description}


REGISTRY: dict[str, Signal] = {}


def register(name: str, target_kind: str, description: str = "") -> Callable:
    """Makes a plan a signal; a name is needed and may be taken once."""
    if not name:
        raise ValueError("a signal needs a name")

    def wrap(plan: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"a signal {name} is registered already")
        REGISTRY[name] = Signal(name, target_kind, plan, description)
        return plan

    return wrap


def build_signals(cfg: Config, only: list[str] | None = None) -> list[Signal]:
    """Enabled signals by name."""
    from murmuration.operators import account_signals, coordination, text_signals  # noqa: F401 - they register themselves

    return [s for name, s in sorted(REGISTRY.items()) if cfg.signal_cfg(name)["enabled"] and (only is None or name in only)]


def make_hits(df: DataFrame, signal: str, params: dict[str, Any], target_kind: str, target: Column, level: Column, intensity: Column, reason: Column, evidence: Column, members: Column | None = None) -> DataFrame:
    """Hits of df's rows; intensity is held between 0 and 1."""
    none = F.lit(None).cast("array<string>")
    return df.select(
        F.lit(signal).alias("signal"), F.lit(signal.split(".")[0]).alias("kind"), target.cast("string").alias("target"), F.lit(target_kind).alias("target_kind"), level.alias("level"),
        clamp(intensity, 0.0, 1.0).cast("double").alias("score"), F.lit(float(params.get("weight", 1.0))).alias("weight"), reason.alias("reason"), F.to_json(evidence).alias("evidence"), (none if members is None else members).alias("members"),
    )


def strong_if(condition: Column) -> Column:
    return F.when(condition, F.lit(STRONG)).otherwise(F.lit(WEAK))


def percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)
