"""Owners whose element sets overlap, counted in sections of bounded memory.

A section is some owners (a run of RUN ids) against a chunk of all owners. It gets the owners of each element that its run
has, once and not once for each pair, and counts what pairs share: elements that many owners have by a product of 0/1
matrices, others by expanding and sorting their pairs. Pairs never move; only edges leave a section.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.session import written

#: Owners of elements, repeats counted, that a section gets at most of a chunk, by their mean over chunks.
CHUNK = 1 << 25
#: Cells (owner, owner) of a section to begin with, and sections for the sake of cores at most.
CELLS, SECTIONS = 1 << 27, 48
#: Owners of elements, repeats counted, that all sections of a chunk get, for each section.
HELD = 1 << 24
#: Cells that are counted at once, pairs that are expanded at once, and rows of matrices at once.
AT_ONCE, EXPANDED, ROWS = 1 << 23, 1 << 22, 256
#: An element of over one in so many cells counts by the product.
DENSE = 150
#: Side tables of so many owners are broadcast.
BROADCAST = 1_000_000

PACKED = "section int, kind int, a_off binary, a binary, b_off binary, b binary"
SETS, SIZES = 0, 1


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ..., counts[0] of them, and so on, for all."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Sections:
    """The plan: n owners by id, in runs of run owners against chunks of chunk ones."""

    def __init__(self, n: int, held: float, all_pairs: float, whole: bool) -> None:
        self.n, self.whole = max(1, n), whole
        chunks = max(1, int(np.ceil(held / CHUNK)))
        few = min(SECTIONS, self.n * float(self.n) / CELLS)
        runs = int(min(self.n, max(1.0, few, all_pairs / chunks / HELD if held > HELD else 1.0)))
        self.run, self.chunk = -(-self.n // runs), -(-self.n // chunks)
        self.runs, self.chunks = -(-self.n // self.run), -(-self.n // self.chunk)

    def count(self) -> int:
        return self.runs * self.chunks

    def met(self, run: int, chunk: int) -> bool:
        """Whether the section has pairs: unless whole, only later owners meet."""
        return self.whole or (chunk + 1) * self.chunk > run * self.run

    def pack_sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Owners of elements (ids: list of ids) to rows of sections."""
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((ids, at))
            ids, at = ids[order], at[order]
            # pieces: an element's owners in one chunk
            key = at * self.chunks + ids // self.chunk
            first = np.flatnonzero(np.diff(key, prepend=-1))
            piece = {}
            owners = np.diff(np.append(first, len(key)))
            for c in range(self.chunks):
                some = key[first] % self.chunks == c
                starts, counts = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
                starts[at[first[some]]], counts[at[first[some]]] = first[some], owners[some]
                piece[c] = starts, counts
            run_of = ids // self.run
            for r in np.unique(run_of):
                mine = np.flatnonzero(run_of == r)
                head = np.flatnonzero(np.diff(at[mine], prepend=-1))
                element, a_counts = at[mine[head]], np.diff(np.append(head, len(mine)))
                for c in range(self.chunks):
                    if not self.met(int(r), c):
                        continue
                    starts, counts = (x[element] for x in piece[c])
                    if not self.whole:
                        # owners before the run's first one of the element meet nobody
                        skip = np.clip(mine[head] - starts, 0, counts)
                        starts, counts = starts + skip, counts - skip
                    on = counts > 0
                    if on.any():
                        kept = np.repeat(on, a_counts)
                        yield self.row(int(r) * self.chunks + c, SETS, offsets(a_counts[on]), ids[mine[kept]], offsets(counts[on]), ids[spans(starts[on], counts[on])])

    def pack_sizes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Owners (id, size) to rows of all sections that see them."""
        for batch in batches:
            ids, sizes = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "size"))
            ids, sizes = ids.astype(np.int32), sizes.astype(np.int64)
            for r in range(self.runs):
                for c in range(self.chunks):
                    seen = (ids // self.run == r) | (ids // self.chunk == c)
                    if self.met(r, c) and seen.any():
                        yield self.row(r * self.chunks + c, SIZES, np.zeros(0, np.int64), ids[seen], np.zeros(0, np.int64), sizes[seen])

    @staticmethod
    def row(section: int, kind: int, *parts: np.ndarray) -> pa.RecordBatch:
        names = [x.split()[0] for x in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([kind], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names)

    def met_pairs(self, section: int, rows: list[tuple], min_shared: int, overlap: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays a, b, shared, total of a section's edges, in order of a and then b."""
        r, c = divmod(section, self.chunks)
        a0, a1 = r * self.run, min(self.n, (r + 1) * self.run)
        b0, b1 = c * self.chunk, min(self.n, (c + 1) * self.chunk)
        wide = b1 - b0
        size_a, size_b = np.zeros(a1 - a0, np.int64), np.zeros(wide, np.int64)
        a_parts, b_parts, a_counts, b_counts = [], [], [], []
        for kind, a_off, a, b_off, b in rows:
            a = np.frombuffer(a, np.int32)
            if kind == SIZES:
                sizes = np.frombuffer(b, np.int64)
                for x0, x1, into in ((a0, a1, size_a), (b0, b1, size_b)):
                    seen = (a >= x0) & (a < x1)
                    into[a[seen] - x0] = sizes[seen]
            else:
                a_parts.append(a - np.int32(a0))
                b_parts.append(np.frombuffer(b, np.int32) - np.int32(b0))
                a_counts.append(np.diff(np.frombuffer(a_off, np.int64)))
                b_counts.append(np.diff(np.frombuffer(b_off, np.int64)))
        if not a_parts:
            return
        rows.clear()
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        n_a, n_b = np.concatenate(a_counts), np.concatenate(b_counts)
        del a_parts, b_parts
        b_off = offsets(n_b)
        hot = n_a.astype(float) * n_b * DENSE > float(a1 - a0) * wide
        element = np.repeat(np.arange(len(n_a)), n_a)
        order = np.argsort(a, kind="stable")
        a, element = a[order], element[order]
        is_hot = hot[element]
        heated = np.flatnonzero(hot)
        hot_a, hot_e = a[is_hot], np.searchsorted(heated, element[is_hot])
        cold_a, cold_e = a[~is_hot], element[~is_hot]
        pairs = np.concatenate([[0], np.cumsum(n_b[cold_e])])

        def expanded(x: int, y: int, start: int) -> np.ndarray:
            """Cells of the pairs of the cold entries x to y, from row start on."""
            e = cold_e[x:y]
            return np.repeat((cold_a[x:y] - start).astype(np.int64) * wide, n_b[e]) + b[spans(b_off[e], n_b[e])]

        def edges(start: int, cells: np.ndarray, shared: np.ndarray):
            i, j = cells // wide + start, cells % wide
            total = size_a[i] + size_b[j] - shared
            keep = (shared >= max(1, min_shared)) & (shared / total >= overlap)
            keep &= (i + a0 != j + b0) if self.whole else (i + a0 < j + b0)
            return (i[keep] + a0).astype(np.int32), (j[keep] + b0).astype(np.int32), shared[keep], total[keep]

        if not len(heated):
            rows_end = np.searchsorted(cold_a, np.arange(a1 - a0), side="right")  # entries up to each owner
            start = 0
            while start < a1 - a0:
                x = rows_end[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(pairs[rows_end], pairs[x] + EXPANDED, side="right")))
                end = min(end, a1 - a0)
                y = rows_end[end - 1]
                if y > x:
                    cells = np.sort(expanded(x, y, start))
                    at = np.flatnonzero(np.diff(cells, prepend=-1))
                    yield edges(start, cells[at], np.diff(np.append(at, len(cells))))
                start = end
            return
        height = max(1, min(a1 - a0, AT_ONCE // wide))
        groups = range(0, len(heated), ROWS)

        def columns(g: int) -> np.ndarray:
            m = np.zeros((min(ROWS, len(heated) - g), wide), np.float32)
            for k, e in enumerate(heated[g : g + ROWS]):
                m[k, b[b_off[e] : b_off[e + 1]]] = 1
            return m

        kept = columns(0) if len(groups) == 1 else None
        for start in range(0, a1 - a0, height):
            end = min(start + height, a1 - a0)
            x, y = np.searchsorted(hot_a, [start, end])
            counts = np.zeros((end - start, wide), np.float32)
            for g in groups:
                some = (hot_e[x:y] >= g) & (hot_e[x:y] < g + ROWS)
                left = np.zeros((end - start, min(ROWS, len(heated) - g)), np.float32)
                left[hot_a[x:y][some] - start, hot_e[x:y][some] - g] = 1
                counts += left @ (columns(g) if kept is None else kept)
            flat = counts.reshape(-1)
            x, y = np.searchsorted(cold_a, [start, end])
            while x < y:
                z = max(x + 1, int(np.searchsorted(pairs, pairs[x] + EXPANDED, side="right")) - 1)
                z = min(z, y)
                cells = np.sort(expanded(x, z, start))
                at = np.flatnonzero(np.diff(cells, prepend=-1))
                flat[cells[at]] += np.diff(np.append(at, len(cells)))
                x = z
            # a bound in few digits first; edges() decides
            low = np.float32(overlap * (1 - 1e-5) / (1 + overlap))
            limit = np.maximum(low * (size_a[start:end, None] + size_b[None, :]).astype(np.float32), np.float32(max(1, min_shared)))
            cells = np.flatnonzero(flat >= limit.reshape(-1))
            yield edges(start, cells, flat[cells].astype(np.int64))

    def each(self, batches: Iterator[pa.RecordBatch], min_shared: int, overlap: float) -> Iterator[tuple]:
        """met_pairs of each section in a task's rows."""
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for section, *rest in zip(*columns):
                held.setdefault(section, []).append(tuple(rest))
        for section in sorted(held):
            yield from self.met_pairs(section, held.pop(section), min_shared, overlap)


class Overlaps:
    """Owners of pairs (owner, element) and what they share.

    owners: (id, owner, size), ids from 0 in the order of names, of owners of min_shared elements or more.
    """

    def __init__(self, pairs: DataFrame, min_shared: int = 3, overlap: float = 0.5, whole: bool = False) -> None:
        self.min_shared, self.overlap, self.spark = min_shared, overlap, pairs.sparkSession
        owned = written(pairs.select("owner", "element").distinct(), "owned")
        sized = owned.groupBy("owner").agg(F.count("*").alias("size")).filter((F.col("size") >= max(1, min_shared)) & F.col("owner").isNotNull())
        self.owners = numbered(sized, "owner")
        self.n = self.owners.count()
        self.hint = F.broadcast if self.n <= BROADCAST else (lambda df: df)
        rows = owned.filter("element is not null").join(self.hint(self.owners.select("id", "owner")), "owner")
        lists = rows.groupBy("element").agg(F.collect_list(F.col("id").cast("int")).alias("ids")).filter(F.size("ids") > 1)
        self.lists = written(lists.select("ids"), "lists")
        f = F.size("ids").cast("double")
        held, pairs_ = self.lists.agg(F.sum(f), F.sum(f * (f - 1))).first()
        self.sections = Sections(self.n, held or 0.0, pairs_ or 0.0, whole)

    def found(self, run, schema: str) -> DataFrame:
        """run(a, b, shared, total), an Arrow batch, of each piece of edges by ids."""
        plan, min_shared, overlap = self.sections, self.min_shared, self.overlap
        rows = self.lists.mapInArrow(plan.pack_sets, PACKED).union(self.owners.select("id", "size").mapInArrow(plan.pack_sizes, PACKED))
        rows = rows.repartitionById(plan.count(), F.col("section"))

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b, shared, total in plan.each(batches, min_shared, overlap):
                if len(a):
                    yield run(a, b, shared, total)

        return rows.mapInArrow(over, schema)

    def edges(self) -> DataFrame:
        """(a, b, shared, total) by owners' names, a < b."""
        plain = lambda *x: pa.RecordBatch.from_arrays([pa.array(y) for y in x], ["id_a", "id_b", "shared", "total"])
        rows = self.found(plain, "id_a int, id_b int, shared long, total long")
        name = lambda x: self.hint(self.owners.select(F.col("id").alias(f"id_{x}"), F.col("owner").alias(x)))
        return rows.join(name("a"), "id_a").join(name("b"), "id_b").select("a", "b", "shared", "total")

    def neighbours(self) -> DataFrame:
        """(id, near): ids of neighbours as bytes of int32, of a higher id unless whole; a node's may be in several rows."""
        return self.found(lambda a, b, shared, total: packed_lists(a, b), "id int, near binary")


def packed_lists(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows of a, which is sorted, with its b as bytes of int32."""
    at = np.flatnonzero(np.diff(a, prepend=-1))
    ends = np.append(at, len(a))[1:]
    near = pa.array([b[x:y].tobytes() for x, y in zip(at, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a[at], pa.int32()), near], ["id", "near"])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with id, from 0 in the order of the column name, which is unique; written."""
    sorted_ = written(rows.orderBy(name).withColumn("_at", F.monotonically_increasing_id()), "owners")
    part = F.shiftright("_at", 33)
    first, sums = {}, 0
    for p, n in sorted(sorted_.groupBy(part.alias("p")).count().collect()):
        first[p], sums = sums, sums + n
    starts = sorted_.sparkSession.createDataFrame(sorted(first.items()) or [(0, 0)], "p long, start long")
    found = sorted_.join(F.broadcast(starts), part == F.col("p")).withColumn("id", F.col("start") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return written(found.select("id", *rows.columns), "numbered")
