"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is analysed into a Boolean query of trigrams that any match must contain. The index holds
the postings (trigram, doc_id) of the trigrams that some rule asks for; a rule's postings are intersected and united as
its query says, its candidates are verified with the expression itself, and rules without mandatory trigrams scan all
texts. Positions are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, read_table, staged, unused

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least least characters; base rules count as such."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A query: a set of alternatives, each a set of trigrams that must all occur. None: no trigram is mandatory.
Query = frozenset[frozenset[str]] | None
MOST_STRINGS = 64
SPANS = "array<struct<start:int,kind:int,end:int,size:int>>"
#: Spans that are appended to one list, and spans from which redaction cuts a text's characters instead of the text.
LAID_ASIDE, MANY = 256, 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simplest(query: set[frozenset[str]]) -> Query:
    if any(not x for x in query):
        return None
    return frozenset(x for x in query if not any(y < x for y in query))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return _simplest({x | y for x, y in product(a, b)})


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that the lower-cased text of each match satisfies."""

    def strings(node) -> set[str] | None:
        """All texts of a node, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            if any(o is not sre.LITERAL for o, _ in arg):
                return None
            return {chr(c).lower() for _, c in arg}
        if op is sre.SUBPATTERN:
            return together(arg[-1])
        if op is sre.BRANCH:
            parts = [together(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            one = together(inner)
            if one is None or most is sre.MAXREPEAT or len(one) ** int(most) > MOST_STRINGS:
                return None
            return {"".join(x) for n in range(least, int(most) + 1) for x in product(one, repeat=n)}
        return {""} if op is sre.AT else None

    def together(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            s = strings(node)
            if s is None or len(out) * len(s) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, s)}
        return out

    def query(nodes) -> Query:
        """Runs of nodes with few texts give trigrams; the nodes between may hold anything but what they need themselves."""
        found: Query = None
        run = {""}

        def flush() -> None:
            nonlocal found, run
            found = _both(found, _simplest({trigrams(x) for x in run}))
            run = {""}

        for node in nodes:
            s = strings(node)
            if s is not None and len(run) * len(s) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, s)}
                continue
            flush()
            if s is not None:
                run = s
            elif node[0] is sre.SUBPATTERN:
                found = _both(found, query(node[1][-1]))
            elif node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] >= 1:
                found = _both(found, query(node[1][2]))
            elif node[0] is sre.BRANCH:
                parts = [query(x) for x in node[1][1]]
                found = _both(found, None if None in parts else _simplest(set().union(*parts)))
        flush()
        return found

    return query(sre_parse.parse(pattern))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules' queries ask for, from the lower-cased whole texts."""
    asked = sorted({t for r in rules for x in trigram_query(r.pattern) or () for t in x})
    if not asked:
        return docs.select(F.lit("").alias("trigram"), "doc_id").limit(0)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select("doc_id", F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked]).alias("found"))
    return found.select("doc_id", F.explode(F.array_compact("found")).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, and for each rule that has a query a boolean): postings are intersected per document by trigram bits."""
    asked = sorted({t for r in rules for x in trigram_query(r.pattern) or () for t in x})
    words = [asked[i : i + 60] for i in range(0, len(asked), 60)]
    bits = [reduce(lambda a, p: a.when(F.col("trigram") == p[1], F.lit(1 << p[0])), enumerate(w), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0)).cast("long") for w in words]
    masks = index.groupBy("doc_id").agg(*[F.bit_or(b).alias(f"m{i}") for i, b in enumerate(bits)])

    def holds(alternative: frozenset[str]) -> Column:
        need = [sum(1 << i for i, t in enumerate(w) if t in alternative) for w in words]
        return reduce(lambda a, b: a & b, [F.col(f"m{i}").bitwiseAND(F.lit(n)) == F.lit(n) for i, n in enumerate(need) if n])

    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    return masks.select("doc_id", *[reduce(lambda a, b: a | b, map(holds, sorted(q, key=sorted))).alias(f"may_{k}") for k, q in queries.items() if q])


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, from the gaps between them and their lengths."""
    pattern = rule.pattern
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(matches.alias("m"), gaps.alias("g"), kept.alias("k"))
    empty, none = F.array().cast(SPANS), F.array().cast(f"array<{SPANS}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.length(x["k"]).alias("size")))
        # appending copies: a full list is laid aside
        full = F.size(acc["out"]) >= LAID_ASIDE
        done = F.when(full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"])
        out = F.when(full, one).otherwise(F.concat(acc["out"], one))
        # the last gap has no match
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), done.alias("done"), out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("done"), empty.alias("out"))
    all_of_them = F.aggregate(rows, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["out"]))
    return F.filter(all_of_them, lambda x: x["size"] >= rule.least)


def spans_column(columns: list[str]) -> str:
    """The name of the column that scan() adds to these."""
    return unused("secret_spans", columns)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secret_spans, array<struct<start, kind, end, size>>, sorted by start, then by the rules' order.

    Null text counts as empty and has no spans; an empty table stays empty. Repeated and null doc_ids are fine: candidates
    are a superset that the expressions verify. Other columns stay; if one is called secret_spans, the new one is
    spans_column(docs.columns). Expressions may not match the empty text.
    """
    asked = [r for r in rules if trigram_query(r.pattern)]
    name = spans_column(docs.columns)
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))

    def found(rows: DataFrame, may: dict[str, Column]) -> DataFrame:
        spans = [F.array().cast(SPANS)]
        for i, rule in enumerate(rules):
            if rule not in asked or rule.kind in may:
                holds = text.rlike(rule.pattern) & may.get(rule.kind, F.lit(True))
                spans.append(F.when(holds, spans_of(rule, i, text)).otherwise(F.array().cast(SPANS)))
        return rows.select(*own, F.array_sort(F.concat(*spans)).alias(name))

    if not asked:
        return found(docs, {})
    flags = [f"may_{r.kind}" for r in asked]
    every = candidates(staged(build_index(docs, rules), "postings"), rules)
    some = staged(every.filter(reduce(lambda a, b: a | b, map(F.col, flags))), "candidates")
    # a document that is no rule's candidate stays where it is
    key, names = unused("may_doc_id", docs.columns), {c: unused(c, docs.columns) for c in flags}
    none, may = Filter(some, "doc_id").split(docs, "doc_id")
    some = some.select(F.col("doc_id").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    joined = may.join(some, may["doc_id"].eqNullSafe(some[key]), "left")
    return found(none, {}).unionByName(found(joined, {r.kind: F.coalesce(F.col(names[f"may_{r.kind}"]), F.lit(False)) for r in asked}))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """text with each stretch of spans replaced by mark, overlapping ones together."""
    empty, none = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def cut(piece) -> Column:
        """piece(from, to): the text between two places."""

        def step(acc: Column, x: Column) -> Column:
            full = F.size(acc["out"]) >= LAID_ASIDE
            put = F.array(piece(acc["at"], x["start"]))
            done = F.when(full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"])
            out = F.when(full, put).otherwise(F.concat(acc["out"], put))
            end = F.greatest(acc["at"], x["end"]).alias("at")
            return F.when(x["start"] >= acc["at"], F.struct(end, done.alias("done"), out.alias("out"))).otherwise(F.struct(end, acc["done"].alias("done"), acc["out"].alias("out")))

        start = F.struct(F.lit(0).alias("at"), none.alias("done"), empty.alias("out"))
        parts = lambda acc: F.concat(F.flatten(acc["done"]), acc["out"], F.array(piece(acc["at"], F.length(text))))
        return F.array_join(F.aggregate(spans, start, step, parts), mark)

    few = cut(lambda a, b: F.substring(text, a + 1, b - a))
    # a place in a text is found by counting from its start, one in an array at once
    letters = F.filter(F.split(text, ""), lambda x: F.length(x) > 0)
    many = F.get(F.transform(F.array(letters), lambda z: cut(lambda a, b: F.array_join(F.slice(z, a + 1, b - a), ""))), F.lit(0))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= MANY, few).otherwise(many)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of secret_spans in text replaced by mark, overlapping ones together; null text stays null.

    A column n_chars follows the text; other columns stay.
    """
    spans = F.col(spans_column(docs.columns))
    out = scan(docs, rules).withColumn("text", redacted(F.col("text"), spans, mark))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of scan() of all documents, one row each; odd rows as there."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < sum(r.base for r in RULES))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        parts.append(
            f"""SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {str(r.base).lower()} AS base,
  unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT, 'n': length(m[i]), 'k': length(k[i])}})) AS s
FROM (SELECT doc_id, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, string_split_regex(t, {quoted(r.pattern)}) AS g, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS k FROM d)"""
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    text = "kind || ':' || s.a || ':' || (s.a + s.n)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({' UNION ALL '.join(parts)}),
f AS (SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
  string_agg({text}, ',' ORDER BY s.a, o) FILTER (base) AS base, string_agg({text}, ',' ORDER BY s.a, o) AS spans
  FROM p WHERE s.k >= CASE o {least} END GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


OP9_SQL = _sql()
