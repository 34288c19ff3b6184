"""Rule books: phrases with tags, fold variants, regular expressions and stopwords.

A folder holds phrases, fold and regexes as .tsv, or as .yaml with the keys groups, fold and rules, and stopwords.txt;
what is missing is empty. Expressions are in Java's dialect; those that don't compile are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

NO_TAG = "未分类"
PACKAGED = Path(__file__).resolve().parent.parent / "rules"
YAML_NAMES = {"phrases": "phrases.yaml", "fold": "evasion.yaml", "regexes": "patterns.yaml"}


@dataclass(frozen=True)
class Phrase:
    text: str
    tag: str
    weight: float


@dataclass(frozen=True)
class Expression:
    tag: str
    weight: float
    pattern: str
    desc: str = ""


@dataclass(frozen=True)
class RuleBook:
    phrases: tuple[Phrase, ...] = ()
    fold_map: dict[str, str] = field(default_factory=dict)
    expressions: tuple[Expression, ...] = ()
    stopwords: frozenset[str] = frozenset()

    @classmethod
    def empty(cls) -> RuleBook:
        return cls()

    @classmethod
    def load(cls, folder: str | Path | None = None) -> RuleBook:
        root = Path(folder) if folder else PACKAGED
        return cls(_phrases(root), _fold(root), _expressions(root), _stopwords(root))

    @cached_property
    def patterns(self) -> tuple[tuple[str, str], ...]:
        """Small-letter phrases without white space around them, each with its first tag."""
        found: dict[str, str] = {}
        for p in self.phrases:
            if key := p.text.strip().lower():
                found.setdefault(key, p.tag)
        return tuple(found.items())

    def group_weight(self, tag: str) -> float:
        return next((p.weight for p in self.phrases if p.tag == tag), 1.0)

    def regex_weight(self, tag: str) -> float:
        return next((e.weight for e in self.expressions if e.tag == tag), 1.0)

    def weight(self, tag: str) -> float:
        """A tag of phrases has their weight, also if an expression shares it."""
        return self.group_weight(tag) if any(p.tag == tag for p in self.phrases) else self.regex_weight(tag)

    def stats(self) -> dict[str, Any]:
        return {"phrase_groups": len({p.tag for p in self.phrases}), "phrases": len(self.phrases), "fold_entries": len(self.fold_map), "regex_rules": len(self.expressions), "stopwords": len(self.stopwords)}


def _rows(path: Path) -> list[list[str]]:
    if not path.exists():
        return []
    lines = path.read_text(encoding="utf-8").splitlines()
    return [x.split("\t") for x in lines if x.strip() and not x.startswith("#")]


def _yaml(root: Path, name: str) -> dict[str, Any]:
    path = root / YAML_NAMES[name]
    if not path.exists():
        return {}
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def _phrases(root: Path) -> tuple[Phrase, ...]:
    found = [Phrase(r[0], r[1], float(r[2])) for r in _rows(root / "phrases.tsv")]
    for group in _yaml(root, "phrases").get("groups") or ():
        tag, weight = str(group.get("tag", NO_TAG)), float(group.get("weight", 1.0))
        found += [Phrase(str(p).strip(), tag, weight) for p in group.get("phrases") or () if str(p).strip()]
    return tuple(found)


def _fold(root: Path) -> dict[str, str]:
    found = {r[0]: r[1] for r in _rows(root / "fold.tsv")}
    return found | {str(k): str(v) for k, v in (_yaml(root, "fold").get("fold") or {}).items() if str(k)}


def compiles(pattern: str) -> bool:
    """Whether Java takes the expression; without a running session, whether Python takes it less Java's own classes."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
            return True
        except Exception:  # noqa: BLE001 - py4j wraps Java's exception
            return False
    try:
        re.compile(re.sub(r"&&\[[^]]*\]|\\p\{\w+\}", r"\\d", pattern))
        return True
    except re.error:
        return False


def _expressions(root: Path) -> tuple[Expression, ...]:
    found = [Expression(r[0], float(r[1]), r[2]) for r in _rows(root / "regexes.tsv")]
    for rule in _yaml(root, "regexes").get("rules") or ():
        if rule.get("pattern"):
            found.append(Expression(str(rule.get("tag", NO_TAG)), float(rule.get("weight", 1.0)), str(rule["pattern"]), str(rule.get("desc", ""))))
    return tuple(e for e in found if compiles(e.pattern))


def _stopwords(root: Path) -> frozenset[str]:
    path = root / "stopwords.txt"
    if not path.exists():
        return frozenset()
    return frozenset(w for x in path.read_text(encoding="utf-8").splitlines() if not x.strip().startswith("#") for w in x.split())
