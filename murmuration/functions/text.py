"""Text functions as column expressions. Positions and lengths are code points."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_ASCII = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]
FULL = "".join(chr(0xFEE0 + c) for c in _ASCII) + "\u3000"
HALF = "".join(map(chr, _ASCII)) + " "
#: What Python's str methods count as white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as a Java character class, without regard to flags.
SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c's value, which is found once however often body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def once(found: Column, keep: Callable[[Column], Column]) -> Column:
    """Rows of found's value where keep holds, for select: found is evaluated once, for the filter and for what follows."""
    return F.explode(F.filter(F.array(found), keep))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def normalize(c: Column) -> Column:
    """Without zero-width characters, with half-width letters and digits, and with white space evened out; null gives ''."""
    # translate deletes what has no counterpart
    x = F.translate(F.coalesce(c, F.lit("")), FULL + ZERO_WIDTH, HALF)
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # lone spaces are left alone: most are
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n")
    return strip(x)


def compact(c: Column) -> Column:
    """The normalised text without white space, which needn't be evened out first."""
    return without_space(F.translate(F.coalesce(c, F.lit("")), FULL + ZERO_WIDTH, HALF))


def fold(c: Column, mapping: dict[str, str]) -> Column:
    """For matching only: variants become what they stand for, letters become small, and all but CJK, letters and digits goes."""
    single = {k: v for k, v in mapping.items() if len(k) == 1}
    # white space goes in any case, unless it stands for something
    x = normalize(c) if any(k in BLANKS for k in single) else F.translate(F.coalesce(c, F.lit("")), FULL + ZERO_WIDTH, HALF)
    plain = {k: v for k, v in single.items() if len(v) == 1 and (v == v.lower()) and ("一" <= v <= "鿿" or v in "abcdefghijklmnopqrstuvwxyz0123456789")}
    variants = lambda c: F.translate(c, "".join(plain), "".join(plain.values())) if plain else c
    x = variants(x)
    others = {k: v for k, v in single.items() if k not in plain}
    if others:
        # values of several or other characters are kept as they are
        kept = F.filter(F.split(x, ""), lambda ch: F.length(ch) > 0)
        pairs = F.create_map(*[F.lit(z) for kv in others.items() for z in kv])
        clean = lambda ch: F.regexp_replace(F.lower(ch), r"[^一-鿿a-z0-9]", "")
        return F.array_join(F.transform(kept, lambda ch: F.coalesce(F.try_element_at(pairs, ch), F.try_element_at(pairs, F.lower(ch)), clean(ch))), "")
    return F.regexp_replace(variants(F.lower(x)), r"[^一-鿿a-z0-9]+", "")


def chars(c: Column) -> Column:
    """The characters of a text, none for the empty one."""
    return F.filter(F.split(c, ""), lambda x: F.length(x) > 0)


def grams(letters: Column, k: int, separator: str = "") -> Column:
    """Joined runs of k elements of an array, in order; none if there are fewer.

    Shifted copies are zipped, so no element of the result looks the whole array up again.
    """
    n = F.greatest(F.size(letters) - (k - 1), F.lit(0))
    out = F.slice(letters, 1, n)
    for i in range(1, k):
        out = F.zip_with(out, F.slice(letters, i + 1, n), lambda x, y: F.concat(x, F.lit(separator), y))
    return out


def tokens(c: Column, stopwords: Iterable[str] = ()) -> Column:
    """Character bigrams of the normalised text without white space (a lone character is a token), less stopwords."""
    # a look-ahead at each place takes two characters without using them up
    pairs = lambda t: F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), F.lit(1))
    found = let(compact(c), lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(pairs(t)))
    stop = sorted({w for w in stopwords if len(w) <= 2})
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def words(c: Column, cut: Callable[[str], Iterable[str]] | None = None, stopwords: Iterable[str] = ()) -> Column:
    """Tokens of a word segmenter in Arrow batches, trimmed, without empty ones and stopwords; without one, tokens().

    cut: normalised text to words; None takes jieba's where that is installed.
    """
    if cut is None:
        try:
            from jieba import lcut as cut
        except ImportError:
            return tokens(c, stopwords)
    stop = frozenset(stopwords)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for x in cut(t) if (w := x.strip()) and w not in stop])

    return run(normalize(c))


def ngrams(toks: Column, n: int) -> Column:
    """Runs of n tokens as arrays; none if n is not positive or there are fewer tokens."""
    if n <= 0:
        return F.array().cast("array<array<string>>")
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.slice(toks, i, n))).otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(toks: Column, n: int) -> Column:
    """Runs of n tokens as texts, each token with \\x1f after it, which hash and compare faster than arrays. Tokens have no \\x1f."""
    if n <= 0:
        return F.array().cast("array<string>")
    # a look-ahead at each token takes n without using them up
    one = "[^\x1f]*\x1f"
    return F.regexp_extract_all(F.array_join(F.transform(toks, lambda t: F.concat(t, F.lit("\x1f"))), ""), F.lit(f"(?=((?:{one}){{{n}}})){one}"), F.lit(1))


def repeat_ratio(toks: Column, n: int = 3) -> Column:
    """Share of n-grams that repeat earlier ones; 0 for fewer than four n-grams."""
    ratio = lambda g: F.when(F.size(g) < 4, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g))
    return let(toks, lambda t: let(joined_ngrams(t, n), ratio))


def max_run(c: Column) -> Column:
    """Length of the longest run of one character."""
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)((.)\2+)"), F.lit(1))
    return let(F.coalesce(c, F.lit("")), lambda t: F.coalesce(F.array_max(F.transform(runs(t), F.length)), F.least(F.length(t), F.lit(1))))


def top_char(c: Column) -> Column:
    """struct<n, place, char> of the most frequent character, the first seen of even ones; null for the empty text."""
    runs = lambda t: F.regexp_extract_all(F.array_join(F.sort_array(chars(t)), ""), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    best = let(c, lambda t: F.array_min(F.transform(runs(t), lambda r: F.struct((-F.length(r)).alias("n"), F.call_function("instr", t, F.substring(r, 1, 1)).alias("place"), F.substring(r, 1, 1).alias("char")))))
    return let(best, lambda best: F.when(best.isNotNull(), F.struct((-best["n"]).alias("n"), best["place"].alias("place"), best["char"].alias("char"))))


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct runs of k characters of the normalised text; a shorter text is its own."""
    few = F.array().cast("array<string>")
    many = lambda s: F.array_distinct(let(chars(s), lambda x: grams(x, k)))
    return let(normalize(c), lambda s: F.when(F.length(s) == 0, few).when(F.length(s) < k, F.array(s)).otherwise(many(s)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def shares_run(a: Column, b: Column, ratio: float) -> Column:
    """Whether the longest common substring reaches ratio of the longer text: they share a run of that many characters."""
    longest = F.greatest(F.length(a), F.length(b))
    k = F.greatest(F.lit(1), F.ceil(longest * F.lit(ratio) - F.lit(1e-9)).cast("int"))
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k))
    enough = (F.length(a) >= k) & (F.length(b) >= k)
    return F.coalesce(F.when(enough, F.arrays_overlap(runs(a), runs(b))), F.lit(False))


def entropy(toks: Column) -> Column:
    """Shannon entropy in bits of a row's tokens; 0 for none."""
    add = lambda acc, n: acc + F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        same = x.eqNullSafe(acc["last"])
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, acc["sum"]).otherwise(add(acc["sum"], acc["run"])).alias("sum"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    total = lambda t: F.aggregate(F.sort_array(t), start, step, lambda acc: add(acc["sum"], acc["run"]))
    return let(toks, lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.log2(F.size(t)) - total(t) / F.size(t)))


def preview(c: Column, size: int = 40) -> Column:
    """The first characters on one line, with an ellipsis if there are more."""
    flat = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def md5_simhash(toks: Column) -> Column:
    """64-bit SimHash of a row's tokens by md5, without Python: a bit is set if most tokens have it; no tokens give 0."""
    high = lambda t, a: F.conv(F.substring(F.md5(t), a, 8), 16, 10).cast("long")
    words = F.transform(toks, lambda t: F.shiftleft(high(t, 1), 32).bitwiseOR(high(t, 9)))

    def bit(w: Column, i: int) -> Column:
        set_ = F.size(F.filter(w, lambda x: F.getbit(x, F.lit(i)) == 1)) * 2 > F.size(w)
        return F.when(set_, F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))

    return let(words, lambda w: reduce(lambda a, b: a.bitwiseOR(b), [bit(w, i) for i in range(64)]))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 less the share of differing bits; two empty fingerprints have nothing in common."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(1 - hamming(a, b) / 64)
