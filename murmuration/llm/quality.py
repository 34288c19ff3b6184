"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts feed boosted trees with histogram splits and a logistic loss; chosen statistics are monotonic
(more symbols never raise the quality). The trees are flattened into numpy node arrays, and a batch of documents walks
all trees at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released

#: Labelled rows that the trees are fitted on, at most: those with the smallest hash of doc_id. Everything else covers all rows.
FIT_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name: direction of the quality score as the statistic grows (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "upper_share": -1, "digit_share": -1, "mark_share": 0, "bang_share": -1, "bar_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1, "non_ascii_share": 0, "words_a_line": 0}


def statistics(text: str) -> tuple[list[int], list[float]]:
    """BASE counts and FEATURES of one whole text; words are runs of characters other than \\x20 and \\x09-\\x0D."""
    data = text.encode()
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    white = int(histogram[9:14].sum() + histogram[32])
    points = int(histogram.sum() - histogram[128:192].sum())
    symbols = int(sum(histogram[b] for b in SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    if n > 5:
        w = h[: n - 4].copy()
        for i in range(1, 5):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : n - 4 + i]
            w ^= w >> np.uint64(29)
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edges = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + 5, -1)
            repeat = int((np.cumsum(edges[:n]) > 0).sum())
    base = [n, points - white, symbols, len(lines) - len(set(lines)), repeat]
    chars, some = max(1, points - white), max(1, n)
    marks = int(histogram[33:48].sum() + histogram[58:65].sum() + histogram[91:97].sum() + histogram[123:127].sum())
    features = [np.log1p(n), (points - white) / some, symbols / chars, histogram[65:91].sum() / chars, histogram[48:58].sum() / chars, marks / chars, histogram[33] / some, histogram[124] / some, base[3] / max(1, len(lines)), repeat / some, len(np.unique(h)) / some, histogram[192:].sum() / chars, n / max(1, len(lines))]
    return base, features


@dataclass
class Trees:
    """Boosted trees as node arrays; a leaf is its own child. Scores are log odds of good quality."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[:, None], len(x), axis=1)
        rows = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=0)


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: int = 5) -> Trees:
    """Newton boosting on histograms. A split on a monotonic feature keeps its children's values in order, and bounds their descendants'."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1) if len(x) else np.zeros(x.shape, int)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots, f = [], np.full(len(y), bias)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        value = float(np.clip(g.sum() / (h.sum() + l2), low, high))
        at = len(nodes)
        nodes.append([0, np.inf, at, at, value * rate])
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, way in enumerate(directions):
                k = len(cuts[j]) + 1
                sg, sh, sn = (np.cumsum(np.bincount(code[rows, j], w, k))[:-1] for w in (g, h, np.ones(len(rows))))
                vl, vr = sg / (sh + l2), (g.sum() - sg) / (h.sum() - sh + l2)
                gain = sg**2 / (sh + l2) + (g.sum() - sg) ** 2 / (h.sum() - sh + l2) - g.sum() ** 2 / (h.sum() + l2)
                gain[(sn < least) | (len(rows) - sn < least) | (way * (vr - vl) < 0)] = -1
                if k > 1 and gain.max() > max(1e-9, best[0] if best else 0):
                    i = int(gain.argmax())
                    best = (gain[i], j, i, float(np.clip(vl[i], low, high)), float(np.clip(vr[i], low, high)))
        if best:
            _, j, i, vl, vr = best
            middle, way = (vl + vr) / 2, directions[j]
            below = code[rows, j] <= i
            bounds = ((low, middle), (middle, high)) if way > 0 else ((middle, high), (low, middle)) if way < 0 else ((low, high), (low, high))
            a = grow(rows[below], level + 1, *bounds[0])
            b = grow(rows[~below], level + 1, *bounds[1])
            nodes[at][:4] = [j, cuts[j][i], a, b]
        return at

    for _ in range(rounds if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        part = np.array(nodes)
        one = Trees(np.array(roots[-1:]), part[:, 0].astype(int), part[:, 1], part[:, 2].astype(int), part[:, 3].astype(int), part[:, 4], 0.0, depth)
        f += one.score(x)
    table = np.array(nodes) if nodes else np.zeros((1, 5))
    return Trees(np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], bias, depth)


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """BASE and FEATURES of each text; null counts as empty."""
    found = [statistics(t.as_py() or "") for t in texts]
    return np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE)), np.array([f for _, f in found], np.float64).reshape(-1, len(FEATURES))


def _stats(docs: DataFrame, extra: list[str], score=None) -> DataFrame:
    """extra columns as they are, BASE and either FEATURES or the score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = _measured(batch.column(len(extra)))
            more = x.T if score is None else [score(x) if len(x) else np.zeros(0)]
            arrays = [*batch.columns[: len(extra)], *(pa.array(c) for c in base.T), *(pa.array(c, pa.float64()) for c in more)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*extra, *BASE, *(list(FEATURES) if score is None else ["quality_score"])])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [f"`{c}` {kinds[c]}" for c in extra] + [f"{c} long" for c in BASE] + ([f"{c} double" for c in FEATURES] if score is None else ["quality_score double"])
    return docs.select(*extra, F.col("text").cast("string").alias("text_")).mapInArrow(released(run), ", ".join(columns))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most fit_rows labelled documents, chosen by hash of doc_id; without labels all scores are even."""
    some = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # fit_rows bounds what is broadcast and what comes to the driver
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    found = _stats(rows, ["doc_id", "quality"]).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    return fit_trees(found[list(FEATURES)].to_numpy(float), found["quality"].to_numpy(float), list(FEATURES.values()))


def quality(docs: DataFrame, trees: Trees, least_score: float = 0.0) -> DataFrame:
    """(doc_id, BASE, quality_score, base_failed, kept) of each row.

    kept: not base_failed, and the trees' log odds reach least_score. Null text counts as empty: it has no words and
    fails. Repeated rows are judged alike; other columns aren't read.
    """
    found = _stats(docs, ["doc_id"], trees.score)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= least_score))


def keep_good(docs: DataFrame, trees: Trees, least_score: float = 0.0) -> DataFrame:
    """The rows of docs that quality() keeps, with docs' columns as they are, judged where they lie."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = _measured(batch.column(at))
            good = (base[:, 0] >= 10) & (100 * base[:, 4] <= 20 * base[:, 0]) & (trees.score(x) >= least_score if len(x) else np.zeros(0, bool))
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(released(run), docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality() of all documents by trees fitted on the labels; odd rows as there. No labels: all scores are even and none rejects."""
    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
