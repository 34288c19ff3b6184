"""The three algorithms that are sequential by nature, as Arrow kernels over bounded groups."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType


def simhash(toks: list[str]) -> int:
    """64-bit SimHash by blake2b: a bit is set if more tokens have it than not; as a signed number."""
    if not len(toks):
        return 0
    words = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in toks), np.uint8)
    votes = 2 * np.unpackbits(words.reshape(len(toks), 8), axis=1).sum(axis=0, dtype=np.int64) - len(toks)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def simhash_udf(toks: pd.Series) -> pd.Series:
    return toks.map(lambda t: simhash(list(t)) if t is not None else 0)


def longest_common_segment(a: str, b: str) -> tuple[int, int, int]:
    """Length and starts of the longest common substring; starts are in the shorter text, then the longer (a first if even).

    The length is found by bisection on sets of substrings; of several the one that ends first in the shorter text.
    """
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:
        k = (low + high + 1) // 2
        seen = {b[i : i + k] for i in range(len(b) - k + 1)}
        if any(a[i : i + k] in seen for i in range(len(a) - k + 1)):
            low = k
        else:
            high = k - 1
    if not low:
        return 0, 0, 0
    seen = {b[i : i + low] for i in range(len(b) - low + 1)}
    at = next(i for i in range(len(a)) if a[i : i + low] in seen)
    return low, at, b.find(a[at : at + low])


@F.pandas_udf(StructType([StructField(x, IntegerType()) for x in ("length", "a_start", "b_start")]))
def longest_common_segment_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [longest_common_segment(x or "", y or "") for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["length", "a_start", "b_start"])


def shares_run(a: str, b: str, ratio: float) -> bool:
    """Whether the longest common substring reaches ratio of the longer text."""
    n = max(len(a), len(b))
    k = next((k for k in range(max(1, int(n * ratio)), n + 1) if k / n >= ratio), n + 1) if n else 1
    if not a or not b or min(len(a), len(b)) < k:
        return False
    if a == b:
        return True
    seen = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in seen for i in range(len(b) - k + 1))


def shares_run_udf(a: Column, b: Column, ratio: float) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and shares_run(p, q, ratio) for p, q in zip(x, y)], dtype="bool")

    return run(a, b)


def sliding_least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each run of window values, in a time that doesn't depend on window: a run is the end of a block and the start of the next."""
    blocks = np.pad(h, (0, -len(h) % window), mode="edge").reshape(-1, window)
    heads = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(h) - window + 1
    return np.minimum(tails[:n], heads[window - 1 : window - 1 + n])


def anchors(text: str, ratio: float) -> list[tuple[int, int]]:
    """(scale, hash) keys of which two texts share one if they share a run of ratio of the longer one's length.

    A text of 2^s characters or more takes part at scale s and those above at which a longer partner may be. At a scale,
    any run of ratio * 2^scale characters holds the same minimiser of shorter grams in both texts.
    """
    n = len(text)
    if not n or ratio <= 0:
        return [(0, 0)]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers, back = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    powers[0] = back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * np.multiply.accumulate(powers))])
    own = n.bit_length() - 1
    out: list[tuple[int, int]] = []
    scale = own
    while int(ratio * (1 << scale)) <= n and scale <= own + 64:
        run = max(1, int(ratio * (1 << scale)))
        gram = max(1, run // 2)
        starts = np.arange(n - gram + 1)
        h = (sums[starts + gram] - sums[starts]) * back[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        window = run - gram + 1
        out += [(scale, int(x)) for x in np.unique(sliding_least(h, window)).view(np.int64)]
        scale += 1
    return out


ANCHORS = ArrayType(StructType([StructField("scale", IntegerType()), StructField("hash", LongType())]))


def anchors_udf(text: Column, ratio: float) -> Column:
    @F.pandas_udf(ANCHORS)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [{"scale": s, "hash": h} for s, h in anchors(t or "", ratio)])

    return run(text)


def greedy_clusters(edges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(leader, member) pairs of a greedy pass in rank order over edges (i, j) with i < j.

    A leader takes the unvisited later ranks that it has an edge to; only groups of least ranks or more are taken.
    """
    near: dict[int, list[int]] = defaultdict(list)
    for i, j in edges:
        near[i].append(j)
    visited: set[int] = set()
    out = []
    for i in sorted(near):
        if i in visited:
            continue
        group = [i, *sorted(j for j in near[i] if j not in visited)]
        if len(group) >= least:
            visited.update(group)
            out += [(i, j) for j in group]
    return out


def greedy_copies(links: list[tuple[int, int]], members: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """greedy_clusters() over ranks of which some have copies, without an edge for each pair of them.

    links (i, j): all copies of i have edges to all of j; (i, i): copies of i to one another. members: (first, rank) of each.
    """
    near: dict[int, set[int]] = defaultdict(set)
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    left: dict[int, list[int]] = defaultdict(list)
    of = {}
    for first, rank in sorted(members, key=lambda m: m[1]):
        left[first].append(rank)
        of[rank] = first
    visited: set[int] = set()
    out = []
    for i, first in of.items():
        if i in visited:
            continue
        later = [(c, at) for c in near[first] if (at := bisect_right(left[c], i)) < len(left[c])]
        size = 1 + sum(len(left[c]) - at for c, at in later)
        if later and size >= least:
            group = sorted(j for c, at in later for j in left[c][at:])
            for c, at in later:
                del left[c][at:]
            visited.update(group)
            out += [(i, j) for j in (i, *group)]
    return out


def list_propagation(ids: np.ndarray, near: list[np.ndarray], sweeps: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Communities by in-place label propagation: nodes in order take their neighbours' most frequent label, the least of
    even ones, until a sweep changes nothing; each community is named by its least member.

    ids with all their neighbours' ids, of which one may have several rows; ids, communities and neighbours inside, sorted.
    """
    nodes, own = np.unique(ids, return_inverse=True)
    order = np.argsort(own, kind="stable")
    sizes = np.array([len(x) for x in near], np.int64)
    ends = np.cumsum(np.bincount(own, sizes, len(nodes)).astype(np.int64))
    flat = np.empty(int(ends[-1]), np.int32)
    at = 0
    for i in order:
        flat[at : at + sizes[i]] = np.searchsorted(nodes, near[i])
        at += sizes[i]
        near[i] = None
    starts = ends - np.diff(ends, prepend=0)
    labels = np.arange(len(nodes), dtype=np.int32)
    for _ in range(sweeps):
        moved = False
        for x, (i, j) in enumerate(zip(starts.tolist(), ends.tolist())):
            seen = labels[flat[i:j]]
            if j - i == 1:
                best = seen[0]
            elif seen.max() < 64 * (j - i):
                best = np.bincount(seen).argmax()
            else:
                found, votes = np.unique(seen, return_counts=True)
                best = found[votes.argmax()]
            moved |= labels[x] != best
            labels[x] = best
        if not moved:
            break
    first = np.unique(labels, return_index=True)
    names = np.zeros(len(nodes), np.int32)
    names[first[0]] = nodes[first[1]]
    inside = np.array([np.count_nonzero(labels[flat[i:j]] == labels[x]) for x, (i, j) in enumerate(zip(starts.tolist(), ends.tolist()))], np.int64)
    return nodes.astype(np.int32), names[labels], inside


def label_propagation(edges: list[tuple[str, str]], sweeps: int = 20) -> dict[str, str]:
    """list_propagation of edges by names."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order = sorted(near)
    place = {x: i for i, x in enumerate(order)}
    _, labels, _ = list_propagation(np.arange(len(order)), [np.array([place[y] for y in near[x]], np.int32) for x in order], sweeps) if order else ([], [], [])
    return {x: order[label] for x, label in zip(order, labels)}
