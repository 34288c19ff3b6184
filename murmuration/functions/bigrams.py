"""Measures of texts' character bigrams as Arrow kernels: the tokens of text.tokens() as numbers, of many texts at once.

A token is a number, code point << 21 | next code point, or LONE for a lone character's second half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.text import BLANKS, FULL, HALF, ZERO_WIDTH

LONE = (1 << 21) - 1
#: Bytes of texts that are held as numbers at once; longer texts are alone.
AT_ONCE = 1 << 20
#: Digests of tokens that a worker keeps.
KEPT = 1 << 18

_table: np.ndarray | None = None
_digests: dict[int, bytes] = {}


def table() -> np.ndarray:
    """What each code point becomes; LONE: nothing."""
    global _table
    if _table is None:
        found = np.arange(0x110000, dtype=np.uint32)
        found[[ord(x) for x in FULL]] = [ord(x) for x in HALF]
        found[[ord(x) for x in ZERO_WIDTH + BLANKS + "　"]] = LONE
        _table = found
    return _table


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in runs of AT_ONCE bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, side="right")))
        yield texts.slice(start, end - start)
        start = end


def tokens(texts: pa.Array, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and tokens of texts, in order."""
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    codes = table()[codes]
    kept = codes != LONE
    codes, rows = codes[kept].astype(np.int64), rows[kept]
    if not len(codes):
        return rows, codes
    joined = np.append(rows[1:] == rows[:-1], False)
    alone = ~joined & ~np.insert(joined[:-1], 0, False)
    found = codes << 21
    found[:-1] |= np.where(joined[:-1], codes[1:], LONE)
    found[-1] |= LONE
    there = joined | alone
    if len(stop):
        there &= ~np.isin(found, stop)
    return rows[there], found[there]


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and each one's place among them."""
    high, low = values >> 21, values & LONE
    present = np.zeros(LONE + 1, bool)
    present[high] = present[low] = True
    letters = np.flatnonzero(present)
    n = len(letters)
    if n * n > 8 * len(values) + (1 << 16):
        return np.unique(values, return_inverse=True)
    place = np.cumsum(present, dtype=np.int64) - 1
    cells = place[high] * n + place[low]
    seen = np.bincount(cells, minlength=n * n) > 0
    at = np.flatnonzero(seen)
    return letters[at // n] << 21 | letters[at % n], (np.cumsum(seen) - 1)[cells]


def word(token: int) -> str:
    return chr(token >> 21) + (chr(token & LONE) if token & LONE != LONE else "")


def number(token: str) -> int:
    return ord(token[0]) << 21 | (ord(token[1]) if len(token) > 1 else LONE)


def counts(rows: np.ndarray, ids: np.ndarray, n: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and counts of the ids that each of n rows has."""
    cells = rows * distinct + ids
    if n * distinct <= 8 * len(ids) + (1 << 16):
        found = np.bincount(cells, minlength=n * distinct)
        at = np.flatnonzero(found)
        return at // max(distinct, 1), at % max(distinct, 1), found[at]
    at, found = np.unique(cells, return_counts=True)
    return at // distinct, at % distinct, found


def sizes_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def repeat_ratios(rows: np.ndarray, found: np.ndarray, n_rows: int, n: int) -> np.ndarray:
    """text.repeat_ratio() of each row: the share of n-grams that repeat earlier ones; 0 for fewer than four."""
    if n <= 0 or len(found) < n:
        return np.zeros(n_rows)
    values, ids = ranked(found)
    many = len(ids) - n + 1
    same = rows[:many] == rows[n - 1 :]
    start, distinct = rows[:many][same], len(values)
    key, size = start.astype(np.int64), n_rows
    for i in range(n):
        if size * float(distinct) >= 2.0**62:
            key = np.unique(key, return_inverse=True)[1]
            size = len(key)
        key, size = key * distinct + ids[i : i + many][same], size * distinct
    first = np.unique(key, return_index=True)[1]
    grams, kinds = np.bincount(start, minlength=n_rows), np.bincount(start[first], minlength=n_rows)
    return np.where(grams < 4, 0.0, 1 - kinds / np.maximum(grams, 1))


def entropies(rows: np.ndarray, found: np.ndarray, n_rows: int) -> np.ndarray:
    """text.entropy() of each row."""
    values, ids = ranked(found)
    at, _, n = counts(rows, ids, n_rows, len(values))
    total, sums = np.bincount(rows, minlength=n_rows), np.bincount(at, n * np.log2(n), n_rows)
    some = total > 0
    out = np.zeros(n_rows)
    out[some] = np.log2(total[some]) - sums[some] / total[some]
    return out


def digest(token: int) -> bytes:
    found = _digests.get(token)
    if found is None:
        if len(_digests) >= KEPT:
            _digests.clear()
        found = _digests[token] = hashlib.blake2b(word(token).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return found


def simhashes(rows: np.ndarray, found: np.ndarray, n_rows: int) -> np.ndarray:
    """kernels.simhash() of each row: each distinct token is hashed once for all rows, and counts for as often as it occurs."""
    values, ids = ranked(found)
    if not len(values):
        return np.zeros(n_rows, np.int64)
    at, token, n = counts(rows, ids, n_rows, len(values))
    bits = np.unpackbits(np.frombuffer(b"".join(map(digest, values.tolist())), np.uint8).reshape(-1, 8), axis=1)
    signs = bits.astype(np.float64) * 2 - 1
    votes = np.zeros((n_rows, 64))
    if n_rows * len(values) <= 8 * len(ids) + (1 << 16):
        table = np.zeros((n_rows, len(values)))
        table[at, token] = n
        votes = table @ signs
    else:
        for i in range(0, len(at), 1 << 17):
            part = slice(i, i + (1 << 17))
            first = np.flatnonzero(np.diff(at[part], prepend=-1))
            np.add.at(votes, at[part][first], np.add.reduceat(signs[token[part]] * n[part, None], first, axis=0))
    return np.packbits(votes > 0, axis=1).view(">i8").reshape(-1).astype(np.int64)


def stops(stopwords: Iterable[str]) -> np.ndarray:
    return np.array(sorted(number(w) for w in stopwords if 1 <= len(w) <= 2), np.int64)


def measured(kind: str, stopwords: Iterable[str], measure: Callable[[np.ndarray, np.ndarray, int], pa.Array]) -> Callable[[Column], Column]:
    """measure(rows, tokens, number of texts) as a function of a text column; null counts as empty."""
    stop = stops(stopwords)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        found = [measure(*tokens(some, stop), len(some)) for some in pieces(texts)]
        return pa.concat_arrays(found) if found else measure(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)

    # else a filter on the measure finds it a second time
    return run.asNondeterministic()


def entropy(text: Column, stopwords: Iterable[str] = ()) -> Column:
    return measured("double", stopwords, lambda r, t, n: pa.array(entropies(r, t, n)))(text)


def simhash(text: Column, stopwords: Iterable[str] = ()) -> Column:
    return measured("long", stopwords, lambda r, t, n: pa.array(simhashes(r, t, n)))(text)


def repetition(text: Column, n: int = 3, stopwords: Iterable[str] = ()) -> Column:
    """struct<n int, ratio double>: tokens, and the share of n-grams that repeat earlier ones."""

    def measure(rows: np.ndarray, found: np.ndarray, many: int) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(sizes_of(rows, many).astype(np.int32)), pa.array(repeat_ratios(rows, found, many, n))], ["n", "ratio"])

    return measured("n int, ratio double", stopwords, measure)(text)


def token_counts(texts: DataFrame, stopwords: Iterable[str] = ()) -> DataFrame:
    """(token, n) of a column text's tokens."""
    stop = stops(stopwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch.column("text").fill_null("")):
                values, ids = ranked(tokens(some, stop)[1])
                n = np.bincount(ids, minlength=len(values))
                yield pa.RecordBatch.from_arrays([pa.array([word(x) for x in values.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["token", "n"])

    return texts.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
