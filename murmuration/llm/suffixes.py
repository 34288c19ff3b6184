"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are retained: the minimisers of word k-grams. Any passage of LEAST words
holds a minimiser among its first WINDOW words, the same in each copy, so each copy retains a suffix whose next
LEAST - WINDOW + 1 words are equal. Suffixes are sorted by a hash of those words and neighbours of different documents
compared. A match is then extended: by 0 to WINDOW - 1 words to the left, and to the right up to LEAST words. The sort
key is a hash, as any order in which equal words are neighbours will do, and all WINDOW extensions of a suffix are sorted
and compared, as the neighbour that agrees furthest to the right needn't be the one that agrees to the left. Extensions
count as equal if two independent 64-bit hashes of their words are, and overlapping ones grow into maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators.graph import connected_components

from .common import Filter, drop, lookup_join, read_table, staged, tidy_shuffles

LEAST, GRAM, WINDOW = 50, 8, 16
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Makes another hash of each word for the second rolling hash.
SECOND = U(0xD6E8FEB86659FD93)


class Words(dict):
    """Hashes of words, the same in each process; starts anew beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(words: list[bytes], memory: Words) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), U, len(words))


class Rolling:
    """Hashes of all stretches of a text's words."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        powers = np.full(n, BASE, U)
        inverse = np.full(n, INVERSE, U)
        if n:
            powers[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, U), np.add.accumulate(h * np.multiply.accumulate(powers))])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        x = (self.sums[starts + size] - self.sums[starts]) * self.inverse[starts]
        x ^= x >> U(31)
        x *= U(0xBF58476D1CE4E5B9)
        return x ^ (x >> U(29))


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window, the first of even ones."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    return np.unique(at + np.arange(len(at)))


def _documents(docs: DataFrame) -> DataFrame:
    """A repeated row (same doc_id and text) is one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _batch(doc: list, at: list, keys: list[list]) -> pa.RecordBatch:
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    arrays = [*(pa.array(join(k, U).view(np.int64)) for k in keys), pa.array(join(doc, np.int64)), pa.array(join(at, np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=[*("key", "check")[: len(keys)], "doc", "at"])


def suffixes(docs: DataFrame, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, doc, at) of the retained suffixes; key: of the next least - window + 1 words."""
    size = least - window + 1
    if size < gram or window + gram - 1 > least:
        raise ValueError("a passage must hold a window of grams and a whole gram after it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in batches:
            doc, keys, at = [], [], []
            texts = batch.column(1)
            for i, d in enumerate(batch.column(0).to_pylist()):
                words = texts[i].as_py().encode().split()
                if len(words) < least:
                    continue
                rolling = Rolling(hashed(words, memory))
                n = len(words)
                p = minimisers(rolling.at(np.arange(n - gram + 1), gram), window)
                p = p[p <= n - size]
                doc.append(np.full(len(p), d))
                keys.append(rolling.at(p, size))
                at.append(p)
            yield _batch(doc, at, [keys])

    return docs.select("doc", "text").mapInArrow(run, "key long, doc long, at int")


def windows(docs: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """(key, check, doc, at) of the windows of least words that start up to window - 1 words before a position in array column at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in batches:
            doc, keys, checks, at = [], [], [], []
            texts, places = batch.column(1), batch.column(2)
            for i, d in enumerate(batch.column(0).to_pylist()):
                h = hashed(texts[i].as_py().encode().split(), memory)
                p = np.asarray(places[i].as_py(), np.int64)
                starts = np.unique((p[:, None] - np.arange(window)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + least <= len(h))]
                doc.append(np.full(len(starts), d))
                keys.append(Rolling(h).at(starts, least))
                other = (h ^ (h >> U(32))) * SECOND
                checks.append(Rolling(other ^ (other >> U(29))).at(starts, least))
                at.append(starts)
            yield _batch(doc, at, [keys, checks])

    return docs.select("doc", "text", "at").mapInArrow(run, "key long, check long, doc long, at int")


def shared(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, at) whose keys stand in another document too, by sorting and comparing neighbours; and links.

    rows: keys (one or two), doc, at. Links (doc, other) join the documents of each key, not each with each. Rows are
    range-sorted by keys and doc, so a hot key spreads over tasks. A task holds the rows of one document and key at most.
    The first and the last run of a task may go on in others: four markers a task tell whether they do. Of what is written,
    only the result stays, and keys only in rows whose run may go on.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.columns[:-2]
    with tidy_shuffles(spark):
        table = staged(rows, name)
    ordered = table.repartitionByRange(parts, *keys, "doc").sortWithinPartitions(*keys, "doc")
    matched, undecided, marker = 0, 1, 2
    names = ["kind", *keys, "doc", "at", "other"]

    def out(kind: int, columns: list[np.ndarray], where: slice | np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        part = [c[where] for c in columns]
        n = len(part[0])
        of_keys = [pa.nulls(n, pa.int64()) if kind == matched else pa.array(c) for c in part[:-2]]
        arrays = [pa.array(np.full(n, kind, np.int8)), *of_keys, pa.array(part[-2]), pa.array(part[-1].astype(np.int32)), pa.array(part[-2] if other is None else other)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(keys) + 2)
        known: tuple[tuple[int, ...], int] | None = None  # the keys of the open run and its first document, once it has two
        first_keys: tuple[int, ...] | None = None
        last: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            keys_at = lambda i: tuple(int(c[i]) for c in columns[: len(keys)])
            if first_keys is None:
                columns = new
                first_keys = keys_at(0)
                yield out(marker, new, slice(0, 1))
            columns = [np.concatenate(x) for x in zip(held, new)]
            doc, n = columns[-2], len(columns[0])
            change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[: len(keys)]])
            first = np.flatnonzero(np.concatenate([[True], change]))
            end = np.append(first[1:], n)
            both, other = doc[first] != doc[end - 1], doc[first].copy()
            if known is not None and keys_at(0) == known[0]:
                both[0], other[0] = True, known[1]
            keep = np.repeat(both, end - first)
            yield out(matched, columns, keep, np.repeat(other, end - first)[keep])
            # the first run of the task ends here without another document in it
            if keys_at(0) == first_keys and len(first) > 1 and not both[0]:
                yield out(undecided, columns, slice(0, end[0]))
            if keys_at(0) == first_keys and (len(first) > 1 or both[0]):
                yield out(marker, columns, slice(end[0] - 1, end[0]))
            known = (keys_at(-1), int(other[-1])) if both[-1] else None
            open_ = n if both[-1] else first[-1]
            held, last = [c[open_:] for c in columns], [c[-1:] for c in columns]
        if last is not None:
            yield out(undecided, held, slice(None))
            yield out(marker, last, slice(None))

    kinds = "kind byte, " + "".join(f"{k} long, " for k in keys) + "doc long, at int, other long"
    with tidy_shuffles(spark):
        found = staged(ordered.mapInArrow(compare, kinds), name + "-matched")
    drop(table)
    # several rows a task at most: the documents of the keys at the borders of tasks, of which two tell enough
    markers = found.filter(F.col("kind") == marker)
    ends = staged(markers.groupBy(*keys).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select(*keys, "a"), name + "-ends")
    late = found.filter(F.col("kind") == undecided).join(ends, keys)
    inside = found.filter(F.col("kind") == matched)
    links = inside.select("doc", "other").union(late.select("doc", "a")).union(markers.join(ends, keys).select("doc", "a")).filter("doc <> other").distinct()
    return inside.select("doc", "at").unionByName(late.select("doc", "at")), links


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_spans, n_repeated_words, spans (its passages of least words or more that other
    documents hold too), class_id and class_size (of the documents that passages join, directly or through others).

    spans: "start:end" in words (runs of characters other than ASCII white space), end exclusive, comma-joined, disjoint and in
    order; adjoining ones are one. class_id: the least doc_id of the class; a null one never is, unless all are. Null text counts
    as empty; short texts have no spans and are their own class; a repeated row (same doc_id and text) is no other document and
    gives one row. An empty table gives no rows; other columns aren't read.
    """
    rows = _documents(docs)
    found, _ = shared(suffixes(rows, least, gram, window), "suffixes")
    places = staged(found.groupBy("doc").agg(F.collect_list("at").alias("at")), "places")
    texts = Filter(places, "doc").split(rows, "doc")[1]  # most without a match don't move
    extended, links = shared(windows(texts.join(places, "doc"), least, window), "windows")
    spans = extended.groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for p in batch.column(2).to_pylist():
                s = np.asarray(p or [], np.int64)
                first = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + least])) if len(s) else np.zeros(0, np.int64)
                a, b = s[first], (s[np.append(first[1:], len(s)) - 1] + least if len(s) else s)
                out[0].append(len(a))
                out[1].append(int((b - a).sum()))
                out[2].append(",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist())))
            types = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, t) for x, t in zip(out, types))], names=["doc", "doc_id", "n_spans", "n_repeated_words", "spans"])

    ids = staged(rows.select("doc", "doc_id").distinct(), "ids")
    spans = ids.join(spans, "doc", "left").select("doc", "doc_id", "at").mapInArrow(grow, "doc long, doc_id long, n_spans long, n_repeated_words long, spans string")
    labels = connected_components(links.select(F.col("doc").alias("a"), F.col("other").alias("b"))).toDF("doc", "label")
    joined = staged(ids.join(labels, "doc"), "joined")
    classes = joined.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    of = lookup_join(joined, classes, ["label"], "class_size", joined.count()).select("doc", "class_id", "class_size")
    size = F.coalesce("class_size", F.lit(1)).cast("long")
    return spans.join(of, "doc", "left").select("doc_id", "n_spans", "n_repeated_words", "spans", F.coalesce("class_id", "doc_id").alias("class_id"), size.alias("class_size"))


def op4_sparse_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_passages() of all documents, which defines odd rows."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))
