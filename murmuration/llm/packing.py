"""Bulk-synchronous best-fit packing of token sequences.

Pieces are range-sorted by length, so that each holds a rank among those of its length. A superstep takes one length,
longest first: its pieces sweep over the open gaps in order of size from their successor (the smallest gap that holds
them) on; pieces that want one gap are told apart by rank, the gaps they fill shrink, and the next length follows.
Pieces of one length and gaps of one size are interchangeable, so the sweep runs over runs of ranks and runs of gaps:
its state is bounded by the sequence length, whatever the number of documents; it is the sequential best-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, tokenizer
from .common import read_table, released, staged, unused

SEQUENCE = 2048


def cut(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut if longer than size.

    Then all pieces but the first have size ids. Null text counts as empty: its document is the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            texts = batch.column(1)
            for i, key in enumerate(batch.column(0).to_pylist()):
                raw = bpe.encode(texts[i].as_py() or "") + end
                n, at, k = len(raw) // 4, 0, 0
                while at < n:
                    length = n - at if n - at <= size else (n - at - 1) % size + 1 if at == 0 else size
                    for c, v in zip(cols, (key, k, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]))):
                        c.append(v)
                    at, k = at + length, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(released(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, pieces a sequence, first offset) that place every piece.

    counts: pieces of each length from 1 to size. Rank r of a row's ranks goes to sequence first + (r - first rank) //
    pieces a sequence. The number of rows follows size, not the counts.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes, rows, used = 0, [], 0

    def put(space: int, first: int, n: int) -> None:
        nonlocal sizes
        if space and n:
            gaps.setdefault(space, []).append((first, n))
            sizes |= 1 << space

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            above = sizes >> length
            if above:
                space = length + (above & -above).bit_length() - 1
                first, n = gaps[space].pop()
                if not gaps[space]:
                    sizes &= ~(1 << space)
                each = space // length
                need = min(n, -(-left // each))
                put(space, first + need, n - need)
            else:
                space, each = size, size // length
                first, need = used, -(-left // each)
                used += need
            placed = min(left, need * each)
            rows.append((length, rank, placed, first, each, size - space))
            full, rest = divmod(placed, each)
            put(space - each * length, first, full)
            if rest:
                put(space - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to size; columns of these names are replaced, all others stay.

    Rows keep their number; ties of length go by doc_id and piece, repeated rows by place; null doc_ids are fine. An empty
    table stays empty.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(*[F.col(f"`{c}`") for c in names])
    n_parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("length"), F.xxhash64("doc_id", "piece"), "doc_id", "piece"]
    parts = pieces.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    part_name, at_name = unused("part", names), unused("at", names)
    length_at = names.index("length")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def ranked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in it:
            v = batch.column(length_at).to_numpy(zero_copy_only=False)
            if not len(v):
                continue
            start = np.concatenate([[True], v[1:] != v[:-1]])
            at = np.arange(len(v)) - np.maximum.accumulate(np.where(start, np.arange(len(v)), 0))
            if v[0] == last:
                head = np.flatnonzero(start)[1] if start.sum() > 1 else len(v)
                at[:head] += seen
            last, seen = v[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(at.astype(np.int64))], names=[*names, part_name, at_name])

    sorted_rows = staged(parts.mapInArrow(ranked, f"{fields}, {part_name} int, {at_name} long"), "sorted")
    # range-sorted: at most one row for each length and one for each part
    heads = sorted_rows.groupBy(part_name, "length").count().collect()
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for part, length, n in sorted(map(tuple, heads)):
        before[part, length] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    plan = best_fit(counts, size)
    wide = np.int64(1) << 48
    firsts = plan[:, 0] * wide + plan[:, 1]
    by = np.argsort(firsts)
    plan, firsts = plan[by], firsts[by]

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length = batch.column(length_at).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(length):
                continue
            part, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns[len(names) :])
            rank = np.array([before[k] for k in zip(part.tolist(), length.tolist())], dtype=np.int64) + at
            row = plan[np.searchsorted(firsts, length * wide + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return sorted_rows.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of the pieces of all documents that cut() makes, which define odd rows; no documents, no rows."""
    return pack(staged(cut(read_table(spark, sf_dir, "documents"), default_path()), "pieces"))
