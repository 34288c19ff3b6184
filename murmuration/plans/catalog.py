"""Named queries over the driver's tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.functions import bigrams as B
from murmuration.functions import scalars as S
from murmuration.functions import text as T
from murmuration.functions.matching import find_all, scan_expressions, scan_folded, scan_phrases
from murmuration.operators import account_signals, coordination, text_signals
from murmuration.operators.graph import listed_communities, listed_components, listed_density, overlap_edges
from murmuration.operators.hits import Context, build_signals
from murmuration.operators.kernels import shares_run_udf
from murmuration.operators.overlap import Overlaps
from murmuration.plans import evaluate, report
from murmuration.plans.pipeline import Pipeline
from murmuration.plans.scoring import flagged, propagate, ranked
from murmuration.session import written
from murmuration.sources import tables
from murmuration.sources.dataset import Dataset
from murmuration.sources.fieldmap import Adapter, FieldMap, dig, first_of_actor, int_of
from murmuration.sources.rules import Expression, Phrase, RuleBook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rules for the fixtures' Latin prose.
LATIN = RuleBook(
    phrases=(Phrase("license", "boilerplate", 0.8), Phrase("all rights", "boilerplate", 0.8), Phrase("worthless", "abuse", 1.0), Phrase("token", "leak", 0.9), Phrase("theand", "joined", 0.6)),
    fold_map={"é": "e", "ö": "o", "0": "o"},
    expressions=(Expression("mail", 0.9, r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]"), Expression("digits", 0.7, r"[0-9][0-9\-. ]{7,}[0-9]")),
    stopwords=frozenset({"th", "an", "é"}),
)
FACTOR = 0.6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- text functions ----

_Q = "'" + T.FULL + T.ZERO_WIDTH + "'"
NORM = f"""regexp_replace(regexp_replace(regexp_replace(replace(replace(translate(coalesce(text, ''), {_Q}, '{T.HALF}'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""
COMPACT = f"regexp_replace({NORM}, '\\s+', '', 'g')"
FOLDED = f"regexp_replace(translate(lower({NORM}), 'éö0', 'eoo'), '[^一-鿿a-z0-9]', '', 'g')"
DOCS = f"d AS (SELECT doc_id::VARCHAR AS item_id, source AS actor_id, lang AS topic, text, {NORM} AS norm, {COMPACT} AS compact FROM documents)"
TOKENS = f"""{DOCS}, c AS (SELECT item_id, list_filter(string_split(compact, ''), lambda x: x <> '') AS ch FROM d),
t AS (SELECT item_id, list_filter(CASE WHEN len(ch) = 1 THEN ch ELSE list_transform(range(1, len(ch)), lambda i: ch[i] || ch[i + 1]) END, lambda x: x NOT IN ('th', 'an', 'é')) AS tok FROM c)"""
RATIO = f"""{TOKENS}, g AS (SELECT item_id, len(tok) AS n, list_transform(range(1, len(tok) - 1), lambda i: tok[i] || chr(31) || tok[i + 1] || chr(31) || tok[i + 2]) AS g FROM t),
r AS (SELECT item_id, n, CASE WHEN len(g) < 4 THEN 0.0 ELSE 1 - len(list_distinct(g))::DOUBLE / len(g) END AS ratio FROM g)"""


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).items


@query("normalize_text", f"WITH {DOCS} SELECT item_id, length(norm) AS n, md5(norm) AS digest FROM d")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("item_id", T.normalize(F.col("text")).alias("x")).select("item_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@query("fold_text", f"SELECT doc_id::VARCHAR AS item_id, length({FOLDED}) AS n, md5({FOLDED}) AS digest FROM documents")
def fold_text(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("item_id", T.fold(F.col("text"), LATIN.fold_map).alias("x")).select("item_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@query("char_bigrams", f"WITH {TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(tok) AS token FROM t) GROUP BY token")
def char_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return B.token_counts(_docs(spark, folder), LATIN.stopwords)


@query("ngram_repeat_ratio", f"WITH {RATIO} SELECT item_id, round(ratio, 6) AS ratio FROM r")
def ngram_repeat_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("item_id", F.round(B.repetition(F.col("text"), 3, LATIN.stopwords)["ratio"], 6).alias("ratio"))


@query("token_entropy", f"""WITH {TOKENS}, u AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(tok) AS token FROM t) GROUP BY ALL),
e AS (SELECT item_id, sum(n) AS s, sum(n * log2(n)) AS l FROM u GROUP BY item_id)
SELECT t.item_id, round(coalesce(log2(s) - l / s, 0), 6) AS entropy FROM t LEFT JOIN e USING (item_id)""")
def token_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("item_id", F.round(B.entropy(F.col("text"), LATIN.stopwords), 6).alias("entropy"))


CHARS = f"""{DOCS}, u AS (SELECT item_id, unnest(ch) AS x, unnest(range(1, len(ch) + 1)) AS i FROM (SELECT item_id, list_filter(string_split(compact, ''), lambda x: x <> '') AS ch FROM d)),
runs AS (SELECT item_id, max(n) AS run FROM (SELECT item_id, x, i - r AS island, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY item_id, x ORDER BY i) AS r FROM u) GROUP BY ALL) GROUP BY item_id),
tops AS (SELECT item_id, arg_max(x, k) AS top, max(k).n AS n FROM (SELECT item_id, x, {{'n': count(*), 'at': -min(i)}} AS k FROM u GROUP BY item_id, x) GROUP BY item_id),
rep AS (SELECT d.item_id, length(compact) AS size, coalesce(n, 0)::DOUBLE / greatest(length(compact), 1) AS ratio, coalesce(run, 0) AS run, top FROM d LEFT JOIN runs USING (item_id) LEFT JOIN tops USING (item_id))"""


@query("max_run_length", f"WITH {CHARS} SELECT item_id, run::INTEGER AS run FROM rep")
def max_run_length(spark: SparkSession, folder: str) -> DataFrame:
    return text_signals.repetition_measures(_docs(spark, folder)).select("item_id", "run")


@query("top_char_ratio", f"WITH {CHARS} SELECT item_id, top, round(ratio, 6) AS ratio FROM rep")
def top_char_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return text_signals.repetition_measures(_docs(spark, folder)).select("item_id", F.col("top.char").alias("top"), F.round("ratio", 6).alias("ratio"))


@query("item_previews", f"""WITH {DOCS}, p AS (SELECT item_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS x FROM d)
SELECT item_id, CASE WHEN length(x) > 40 THEN substr(x, 1, 40) || '…' ELSE x END AS label FROM p""")
def item_previews(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("item_id", T.preview(F.col("text")).alias("label"))


# ---- rule scans ----

PHRASES = "(VALUES ('license', 'boilerplate'), ('all rights', 'boilerplate'), ('worthless', 'abuse'), ('token', 'leak'), ('theand', 'joined')) AS p(pattern, tag)"
EXPRESSIONS = "(VALUES ('[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]', 'mail'), ('[0-9][0-9\\-. ]{7,}[0-9]', 'digits')) AS e(expr, tag)"
SCANS = f"""ph AS (SELECT item_id, pattern, tag FROM d, {PHRASES} WHERE contains(lower(text), pattern)),
fo AS (SELECT doc_id::VARCHAR AS item_id, pattern, tag FROM (SELECT doc_id, {FOLDED} AS f FROM documents), {PHRASES} WHERE contains(f, pattern)),
ex AS (SELECT item_id, CASE tag WHEN 'mail' THEN regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]') ELSE regexp_extract(text, '[0-9][0-9\\-. ]{{7,}}[0-9]') END AS pattern, tag
  FROM d, (VALUES ('mail'), ('digits')) AS e(tag) WHERE CASE tag WHEN 'mail' THEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]') ELSE regexp_matches(text, '[0-9][0-9\\-. ]{{7,}}[0-9]') END)"""


def _matches(spark: SparkSession, folder: str, scan: Callable) -> DataFrame:
    return _docs(spark, folder).select("item_id", F.explode(scan(F.col("text"), LATIN)).alias("m")).select("item_id", "m.pattern", "m.tag")


@query("phrase_scan", f"WITH {DOCS}, {SCANS} SELECT * FROM ph")
def phrase_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder, scan_phrases)


@query("folded_scan", f"WITH {DOCS}, {SCANS} SELECT * FROM fo")
def folded_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder, scan_folded)


@query("regex_scan", f"WITH {DOCS}, {SCANS} SELECT * FROM ex")
def regex_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder, scan_expressions)


@query("phrase_positions", f"""WITH {DOCS}, m AS (SELECT item_id, pattern, tag, string_split(lower(text), pattern) AS parts FROM d, {PHRASES} WHERE contains(lower(text), pattern))
SELECT item_id, pattern, tag, s AS start, (s + length(pattern))::INTEGER AS "end" FROM (
  SELECT item_id, pattern, tag, unnest(list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(pattern))::INTEGER)) AS s FROM m)""")
def phrase_positions(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).filter(F.size(scan_phrases(F.col("text"), LATIN)) > 0).select("item_id", F.explode(find_all(F.col("text"), LATIN)).alias("m")).select("item_id", "m.pattern", "m.tag", "m.start", "m.end")


# ---- text signals ----

TEMPLATE = "SELECT item_id AS target, CASE WHEN ratio >= 0.42 THEN 'strong' ELSE 'weak' END AS level, greatest(0.3, least(1.0, ratio / 0.42)) AS score FROM r WHERE n >= 12 AND ratio >= 0.22"
REPETITION = """SELECT item_id AS target, CASE WHEN ratio >= 0.2 OR run >= 12 THEN 'strong' ELSE 'weak' END AS level, greatest(0.3, least(1.0, greatest(ratio / 0.2, run / 12.0))) AS score
FROM rep WHERE size >= 10 AND (ratio >= 0.16 OR run >= 6)"""
KEYWORD = """SELECT item_id AS target, CASE WHEN bool_or(tag = 'abuse') OR least(1.0, greatest(0.2, max(w) + least(0.25, 0.08 * (count(DISTINCT tag) - 1)))) >= 0.9 THEN 'strong' ELSE 'weak' END AS level,
  least(1.0, greatest(0.2, max(w) + least(0.25, 0.08 * (count(DISTINCT tag) - 1)))) AS score
FROM (SELECT item_id, tag, CASE tag WHEN 'boilerplate' THEN 0.8 WHEN 'abuse' THEN 1.0 WHEN 'leak' THEN 0.9 WHEN 'joined' THEN 0.6 WHEN 'mail' THEN 0.9 ELSE 0.7 END::DOUBLE AS w FROM (SELECT * FROM ph UNION ALL SELECT * FROM ex)) GROUP BY item_id"""
EVASION = "SELECT item_id AS target, 'strong' AS level, greatest(0.7, least(1.0, 0.7 + 0.1 * (count(*) - 1)))::DOUBLE AS score FROM (SELECT item_id, pattern FROM fo EXCEPT SELECT item_id, pattern FROM ph) GROUP BY item_id"
CTES = f"{RATIO}, {CHARS.split(', ', 1)[1] if False else CHARS[len(DOCS) + 2:]}, {SCANS}"
ROUNDED = "target, level, round(score, 6) AS score"
PARAMS: dict[str, dict[str, Any]] = {
    "text.template": {"weight": 1.0}, "text.repetition": {"weight": 0.7, "char_ratio": 0.16, "strong_ratio": 0.2}, "text.keyword": {"weight": 1.0, "strong_tags": ["abuse"]}, "text.evasion": {"weight": 1.2},
    "account.originality": {"weight": 0.8, "copy_ratio": 0.2, "max_posts": 10**6}, "account.age": {"weight": 0.6, "fresh_days": 2000, "very_fresh_days": 1000}, "account.profile": {"weight": 0.5},
    "coordination.burst": {"weight": 1.4, "min_items": 3, "min_actors": 2}, "coordination.cooccur": {"weight": 1.2, "overlap": 0.3}, "coordination.cluster": {"weight": 1.5, "min_actors": 1, "max_per_topic": None},
}


def _hits(name: str, data: Dataset, **params: Any) -> DataFrame:
    signal = next(s for s in build_signals(Config.default()) if s.name == name)
    return signal.plan(Context(data, LATIN, PARAMS[name] | params))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("target", "level", F.round("score", 6).alias("score"))


@query("signal_template", f"WITH {RATIO} SELECT {ROUNDED} FROM ({TEMPLATE})")
def signal_template(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("text.template", tables.documents(spark, folder)))


@query("signal_repetition", f"WITH {CHARS} SELECT {ROUNDED} FROM ({REPETITION})")
def signal_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("text.repetition", tables.documents(spark, folder)))


@query("signal_keyword", f"WITH {DOCS}, {SCANS} SELECT {ROUNDED} FROM ({KEYWORD})")
def signal_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("text.keyword", tables.documents(spark, folder)))


@query("signal_evasion", f"WITH {DOCS}, {SCANS} SELECT {ROUNDED} FROM ({EVASION})")
def signal_evasion(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("text.evasion", tables.documents(spark, folder)))


# ---- records ----

GRID = [("1693526400",), ("1693526400000",), ("2023-09-01T00:00:00Z",), ("2023-09-01T08:00:00+08:00",), ("2023-09-01 12:30:00",), ("2023/09/01 12:30:00",), ("2023-09-01 12:30",), ("2023-09-01",), ("20230901",), (" 2023-09-01 ",), ("soon",), ("",), (None,)]
TIMES = [1693526400, 1693526400, 1693526400, 1693526400, 1693571400, 1693571400, 1693571400, 1693526400, 20230901, 1693526400, None, None, None]


@query("parse_time_grid", "SELECT raw, seconds::VARCHAR AS seconds FROM (VALUES " + ", ".join(f"({'NULL' if r is None else repr(r)}, {'NULL' if s is None else s})" for (r,), s in zip(GRID, TIMES)) + ") AS g(raw, seconds)")
def parse_time_grid(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(GRID, "raw string").select("raw", F.unix_seconds(S.parse_time(F.col("raw"))).cast("string").alias("seconds"))


@query("parse_event_times", "SELECT event_id, epoch_us(ts) AS us FROM events")
def parse_event_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "events").select("event_id", F.col("ts").cast("string").alias("raw"))
    return rows.select("event_id", F.unix_micros(S.parse_time(F.col("raw"))).alias("us"))


@query("dig_props", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def dig_props(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("record"))
    return rows.select("event_id", int_of(dig(F.col("record"), "k")).alias("k"))


def _event_records(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    record = F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("uid")).alias("user"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("body"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.array(F.struct(F.col("event_type").alias("name"))).alias("tags"))
    return e.select(F.col("event_id").alias("seq"), F.parse_json(F.to_json(record)).alias("record"))


EVENT_MAP = FieldMap(item_id="id", actor_id="user.uid", text="body", created_at="at", topic="tags.0.name")


@query("mapped_items", "SELECT event_id::VARCHAR AS item_id, user_id::VARCHAR AS actor_id, event_type AS text, event_type AS topic, epoch_ms(date_trunc('second', ts)) // 1000 AS seconds FROM events WHERE event_type <> 'click'")
def mapped_items(spark: SparkSession, folder: str) -> DataFrame:
    items = Adapter(EVENT_MAP).items(_event_records(spark, folder))
    return items.select("item_id", "actor_id", "text", "topic", F.unix_seconds("created_at").alias("seconds"))


@query("skip_count", "SELECT count(*) AS records, count(*) FILTER (event_type = 'click') AS skipped FROM events")
def skip_count(spark: SparkSession, folder: str) -> DataFrame:
    return Adapter(EVENT_MAP).skipped(_event_records(spark, folder))


@query("first_wins_dedup", "SELECT user_id::VARCHAR AS actor_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def first_wins_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return first_of_actor(tables.events(spark, folder).items.select("actor_id", "seq", F.col("text").alias("first_type")))


@query("topic_counts", "SELECT lang AS topic, count(*) AS items FROM documents GROUP BY lang")
def topic_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).by_topic()


@query("actor_counts", "SELECT source AS actor_id, count(*) AS items FROM documents GROUP BY source")
def actor_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).by_actor()


@query("time_span", "SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def time_span(spark: SparkSession, folder: str) -> DataFrame:
    return tables.events(spark, folder).time_span().select(F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


# ---- account signals ----

AGE = """WITH o AS (SELECT o_custkey::VARCHAR AS target, min(o_orderdate) AS first_at FROM orders GROUP BY ALL), a AS (SELECT target, (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(first_at)) / 8.64e10 AS age FROM o)
SELECT target, CASE WHEN age <= 1000 THEN 'strong' ELSE 'weak' END AS level, round(greatest(0.3, least(1.0, 1.0 - age / 2000)), 6) AS score FROM a WHERE age < 2000 AND target IN (SELECT c_custkey::VARCHAR FROM customer)"""
PROFILE = """WITH p AS (SELECT c_custkey::VARCHAR AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.2 ELSE 0.0 END::DOUBLE
  + CASE WHEN greatest(0, floor(c_acctbal)) / (c_nationkey + 1) >= 5 THEN 0.3 ELSE 0.0 END::DOUBLE AS total FROM customer)
SELECT target, CASE WHEN total >= 0.6 THEN 'strong' ELSE 'weak' END AS level, round(total, 6) AS score FROM p WHERE total >= 0.4"""
#: Texts of events are one of few words: pairs of equal words of five letters or more are the copies, others share too little.
PAIRS = """k AS (SELECT user_id::VARCHAR AS actor_id, event_type, count(*) AS n FROM events GROUP BY ALL), cp AS (SELECT actor_id, sum(n * (n - 1) // 2) AS copies, sum(n) * (sum(n) - 1) // 2 AS pairs, sum(n) AS posts FROM k GROUP BY actor_id),
orig AS (SELECT actor_id AS target, copies::DOUBLE / pairs AS ratio FROM cp WHERE posts >= 5 AND copies::DOUBLE / pairs >= 0.2)"""
ORIGINALITY = "SELECT target, CASE WHEN ratio >= 0.2 * 1.3 THEN 'strong' ELSE 'weak' END AS level, greatest(0.4, least(1.0, ratio / (0.2 * 1.3)))::DOUBLE AS score FROM orig"


@query("signal_age", AGE)
def signal_age(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("account.age", tables.orders(spark, folder)))


@query("signal_profile", PROFILE)
def signal_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("account.profile", tables.orders(spark, folder)))


@query("copy_ratios", f"WITH {PAIRS} SELECT actor_id, posts::BIGINT AS posts, pairs::BIGINT AS pairs, copies::BIGINT AS copies FROM cp WHERE posts >= 5")
def copy_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return account_signals.copy_ratios(tables.events(spark, folder).items, 5, 10**6).select("actor_id", "posts", "pairs", "copies")


@query("signal_originality", f"WITH {PAIRS} SELECT {ROUNDED} FROM ({ORIGINALITY})")
def signal_originality(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("account.originality", tables.events(spark, folder)))


# ---- coordination ----

WINDOWS = """w AS (SELECT event_type AS topic, user_id, epoch_us(ts) AS us, count(*) OVER f AS n, min(epoch_us(ts)) OVER f AS first_us FROM events WINDOW f AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)),
bw AS (SELECT topic, n, first_us, us AS last_us FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, us) AS r FROM w) WHERE r = 1 AND n >= 3)"""
BURSTS = f"""{WINDOWS}, s AS (SELECT *, greatest((last_us - first_us) / 1e6, 1.0) AS span, (SELECT count(*) / greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 1.0) FROM events) AS background FROM bw),
br AS (SELECT *, n / span / background AS ratio FROM s WHERE n / span / background >= 2.5),
members AS (SELECT DISTINCT br.topic, user_id::VARCHAR AS actor FROM br JOIN events e ON e.event_type = br.topic AND epoch_us(e.ts) BETWEEN first_us AND last_us),
b AS (SELECT br.*, a.actors FROM br JOIN (SELECT topic, count(*) AS actors FROM members GROUP BY topic) a USING (topic) WHERE a.actors >= 2),
bh AS (SELECT topic, 'burst:' || topic || ':' || strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN first_us % 1000000 = 0 THEN '' ELSE '.' || lpad((first_us % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS target,
  CASE WHEN n >= 6 THEN 'strong' ELSE 'weak' END AS level, greatest(0.4, least(1.0, 0.5 + (ratio - 2.5) / 2.5)) AS score FROM b)"""


@query("trailing_counts", f"WITH {WINDOWS} SELECT topic, user_id::VARCHAR AS actor_id, us, n, first_us FROM w")
def trailing_counts(spark: SparkSession, folder: str) -> DataFrame:
    return coordination.trailing_counts(tables.events(spark, folder), 300).select("topic", "actor_id", "us", "n", "first_us")


@query("burst_windows", f"WITH {WINDOWS} SELECT topic, n, first_us, last_us FROM bw")
def burst_windows(spark: SparkSession, folder: str) -> DataFrame:
    return coordination.best_windows(tables.events(spark, folder), 300, 3)


@query("signal_burst", f"WITH {BURSTS} SELECT {ROUNDED} FROM bh")
def signal_burst(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("coordination.burst", tables.events(spark, folder)))


EDGES = """ats AS (SELECT DISTINCT user_id::VARCHAR AS actor, strftime(ts, '%Y-%m-%d') || ' ' || event_type AS topic FROM events), sz AS (SELECT actor, count(*) AS n FROM ats GROUP BY actor),
edges AS (SELECT x.actor AS a, y.actor AS b, count(*) AS shared, any_value(p.n + q.n) - count(*) AS total FROM ats x JOIN ats y ON x.topic = y.topic AND x.actor < y.actor JOIN sz p ON p.actor = x.actor JOIN sz q ON q.actor = y.actor
  GROUP BY ALL HAVING count(*) >= 3 AND count(*)::DOUBLE / (any_value(p.n + q.n) - count(*)) >= 0.3)"""


def _overlaps(spark: SparkSession, folder: str, whole: bool = False) -> Overlaps:
    return Overlaps(coordination.topic_pairs(tables.daily_events(spark, folder)), 3, 0.3, whole)


@query("cooccur_edges", f"WITH {EDGES} SELECT a, b, shared, total::BIGINT AS total FROM edges")
def cooccur_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).edges()


@query("supplier_edges", """WITH ats AS (SELECT DISTINCT l_suppkey::VARCHAR AS actor, l_partkey::VARCHAR AS topic FROM lineitem), sz AS (SELECT actor, count(*) AS n FROM ats GROUP BY actor)
SELECT x.actor AS a, y.actor AS b, count(*) AS shared, (any_value(p.n + q.n) - count(*))::BIGINT AS total FROM ats x JOIN ats y ON x.topic = y.topic AND x.actor < y.actor JOIN sz p ON p.actor = x.actor JOIN sz q ON q.actor = y.actor
GROUP BY ALL HAVING count(*) >= 3 AND count(*)::DOUBLE / (any_value(p.n + q.n) - count(*)) >= 0.16""")
def supplier_edges(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_edges(coordination.topic_pairs(tables.supplied_parts(spark, folder)), 3, 0.16)


@query("edge_components", f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def edge_components(spark: SparkSession, folder: str) -> DataFrame:
    met = _overlaps(spark, folder)
    return listed_components(met.neighbours(), met.owners)


@query("cooccur_communities")
def cooccur_communities(spark: SparkSession, folder: str) -> DataFrame:
    met = _overlaps(spark, folder, True)
    return listed_communities(written(met.neighbours(), "neighbours"), met.owners).select("node", "community")


@query("edge_density", f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
c AS (SELECT node, min(other) AS community FROM reach GROUP BY node), s AS (SELECT community, count(*) AS size FROM c GROUP BY community)
SELECT community, any_value(size) AS size, count(*) AS inside, round(count(*) / (any_value(size) * (any_value(size) - 1) / 2), 6) AS density FROM edges JOIN c ON c.node = edges.a JOIN s USING (community) GROUP BY community""")
def edge_density(spark: SparkSession, folder: str) -> DataFrame:
    met = _overlaps(spark, folder)
    lists = written(met.neighbours(), "neighbours")
    parts = listed_components(lists, met.owners).withColumnRenamed("component", "community")
    later = lists.join(met.owners, "id").groupBy(F.col("owner").alias("node")).agg(F.sum(F.length("near") / 4).alias("inside"))
    member = parts.join(later, "node", "left")
    return listed_density(member, False).select("community", "size", "inside", F.round("density", 6).alias("density"))


@query("signal_cooccur")
def signal_cooccur(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("coordination.cooccur", tables.daily_events(spark, folder)))


@query("simhash_fingerprints")
def simhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("item_id", B.simhash(F.col("text"), LATIN.stopwords).alias("print"))


@query("simhash_pairs_md5", """WITH c AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '\\s+', '', 'g'), ''), lambda x: x <> '') AS ch FROM conversations),
t AS (SELECT conv_id, turn, unnest(CASE WHEN len(ch) = 1 THEN ch ELSE list_transform(range(1, len(ch)), lambda i: ch[i] || ch[i + 1]) END) AS tok FROM c),
h AS (SELECT conv_id, turn, ('0x' || substr(md5(tok), 1, 16))::UBIGINT AS h FROM t), bits AS (SELECT conv_id, turn, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit FROM h, range(64) AS r(i) GROUP BY ALL)
SELECT conv_id::VARCHAR AS topic, x.turn AS a, y.turn AS b, sum(CASE WHEN x.bit <> y.bit THEN 1 ELSE 0 END)::INTEGER AS distance FROM bits x JOIN bits y USING (conv_id, i) WHERE x.turn < y.turn GROUP BY ALL""")
def simhash_pairs_md5(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("topic"), "turn", T.md5_simhash(T.tokens(F.col("text"))).alias("h"))
    return rows.alias("x").join(rows.alias("y"), "topic").filter("x.turn < y.turn").select("topic", F.col("x.turn").alias("a"), F.col("y.turn").alias("b"), T.hamming(F.col("x.h"), F.col("y.h")).alias("distance"))


@query("copy_pairs", """WITH p AS (SELECT conv_id::VARCHAR AS topic, x.turn AS a, y.turn AS b, x.text AS s, y.text AS t, greatest(1, ceil(greatest(length(x.text), length(y.text)) * 0.05 - 1e-9))::INTEGER AS k FROM conversations x JOIN conversations y USING (conv_id) WHERE x.turn < y.turn)
SELECT topic, a, b FROM p WHERE length(s) >= k AND length(t) >= k AND list_has_any(list_transform(range(1, length(s) - k + 2), lambda i: substr(s, i, k)), list_transform(range(1, length(t) - k + 2), lambda i: substr(t, i, k)))""")
def copy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("topic"), "turn", "text")
    x = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "topic").alias("x")
    return x.join(rows.alias("y"), "topic").filter("x.turn < y.turn").filter(shares_run_udf(F.col("x.text"), F.col("y.text"), 0.05)).select("topic", F.col("x.turn").alias("a"), F.col("y.turn").alias("b"))


@query("signal_cluster")
def signal_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_hits("coordination.cluster", tables.documents(spark, folder)))


# ---- scoring ----

ALL_HITS = f"""{PAIRS}, {BURSTS}, h1 AS (SELECT 'account.originality' AS signal, 'account' AS kind, 'actor' AS target_kind, target, level, score, 0.8 AS weight, NULL AS topic FROM ({ORIGINALITY})
  UNION ALL SELECT 'coordination.burst', 'coordination', 'group', target, level, score, 1.4, topic FROM bh)"""
TARGETS = "tg AS (SELECT 'item' AS target_kind, event_id::VARCHAR AS target FROM events UNION SELECT 'actor', user_id::VARCHAR FROM events)"


def _judged(hits: str, name: str) -> str:
    return f"""{name}0 AS (SELECT target_kind, target, sum(score * CASE level WHEN 'strong' THEN 1.5 ELSE 1.0 END * weight * CASE kind WHEN 'text' THEN 0.9 WHEN 'account' THEN 0.7 ELSE 1.3 END) AS raw, count(DISTINCT kind) AS kinds, bool_or(level = 'strong') AS any_strong, count(*) AS n FROM {hits} GROUP BY ALL),
{name}1 AS (SELECT target_kind, target, least(100.0, coalesce(raw, 0) * 25 + CASE WHEN kinds >= 2 THEN (kinds - 1) * 8.0 ELSE 0.0 END)::DOUBLE AS score, coalesce(any_strong, false) AS any_strong, coalesce(n, 0) AS n_hits FROM tg FULL JOIN {name}0 USING (target_kind, target)),
{name} AS (SELECT target_kind, target, score, CASE WHEN score >= 50 THEN 'strong' WHEN score >= 20 OR any_strong THEN 'weak' ELSE 'clean' END AS level, n_hits FROM {name}1)"""


PASS1 = f"{ALL_HITS}, {TARGETS}, {_judged('h1', 'a1')}"
PROPAGATED = f"""pm AS (SELECT topic, actor, row_number() OVER (PARTITION BY topic ORDER BY actor) AS r FROM members),
pr AS (SELECT 'coordination.burst#member' AS signal, 'coordination' AS kind, 'actor' AS target_kind, actor AS target, 'weak' AS level, bh.score * {FACTOR} AS score, 1.4 AS weight, NULL AS topic
  FROM bh JOIN a1 ON a1.target_kind = 'group' AND a1.target = bh.target AND a1.level <> 'clean' JOIN pm ON pm.topic = bh.topic AND r <= 30)"""
PASS2 = f"{PASS1}, {PROPAGATED}, h2 AS (SELECT * FROM h1 UNION ALL SELECT * FROM pr), {_judged('h2', 'a2')}"
SHOWN = "target_kind, target, round(score, 6) AS score, level, n_hits"


def _scored(spark: SparkSession, folder: str) -> tuple[Pipeline, Dataset, DataFrame]:
    data = tables.events(spark, folder)
    pipeline = Pipeline(Config.default(), LATIN)
    return pipeline, data, written(_hits("account.originality", data).unionByName(_hits("coordination.burst", data)), "hits")


def _pass1(spark: SparkSession, folder: str) -> DataFrame:
    pipeline, data, hits = _scored(spark, folder)
    return pipeline.scorer.assess(hits, pipeline.targets(data))


def _pass2(spark: SparkSession, folder: str) -> DataFrame:
    pipeline, data, hits = _scored(spark, folder)
    return pipeline.score(hits, pipeline.targets(data), None)[1]


def _assessed(df: DataFrame) -> DataFrame:
    return df.select("target_kind", "target", F.round("exact_score", 6).alias("score"), "level", F.col("n_hits").cast("long").alias("n_hits"))


@query("score_pass1", f"WITH {PASS1} SELECT {SHOWN} FROM a1")
def score_pass1(spark: SparkSession, folder: str) -> DataFrame:
    return _assessed(_pass1(spark, folder))


@query("propagated_hits", f"WITH {PASS1}, {PROPAGATED} SELECT signal, target, round(score, 6) AS score FROM pr")
def propagated_hits(spark: SparkSession, folder: str) -> DataFrame:
    return propagate(_pass1(spark, folder), FACTOR).select("signal", "target", F.round("score", 6).alias("score"))


@query("score_pass2", f"WITH {PASS2} SELECT {SHOWN} FROM a2")
def score_pass2(spark: SparkSession, folder: str) -> DataFrame:
    return _assessed(_pass2(spark, folder))


@query("levels_summary", f"""WITH {PASS2} SELECT count(*) AS assessed, count(*) FILTER (n_hits = 0) AS no_signal, count(*) FILTER (level = 'clean') AS clean, count(*) FILTER (level = 'weak') AS weak, count(*) FILTER (level = 'strong') AS strong, count(*) FILTER (level <> 'clean') AS flagged,
count(*) FILTER (level <> 'clean' AND target_kind = 'item') AS flagged_item, count(*) FILTER (level <> 'clean' AND target_kind = 'actor') AS flagged_actor, count(*) FILTER (level <> 'clean' AND target_kind = 'group') AS flagged_group FROM a2""")
def levels_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary_counts(_pass2(spark, folder))


@query("top_signals", f"WITH {PASS2} SELECT signal, count(*) AS n FROM h2 JOIN a2 USING (target_kind, target) WHERE a2.level <> 'clean' GROUP BY signal ORDER BY n DESC, signal LIMIT 5")
def top_signals(spark: SparkSession, folder: str) -> DataFrame:
    return report.signal_counts(_pass2(spark, folder)).orderBy(F.desc("n"), "signal").limit(5)


@query("flagged_targets", f"WITH {PASS2} SELECT {SHOWN} FROM a2 WHERE level <> 'clean'")
def flagged_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _assessed(flagged(_pass2(spark, folder)))


@query("top_targets", f"WITH {PASS2} SELECT target_kind, target, round(score, 2) AS score FROM a2 ORDER BY round(score, 2) DESC, target, target_kind LIMIT 20")
def top_targets(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(_pass2(spark, folder)).select("target_kind", "target", "score").limit(20)


@query("text_scores", f"""WITH {CTES}, h1 AS (SELECT 'text' AS kind, 'item' AS target_kind, target, level, score, 1.0 AS weight FROM ({TEMPLATE}) UNION ALL SELECT 'text', 'item', target, level, score, 0.7 FROM ({REPETITION})
  UNION ALL SELECT 'text', 'item', target, level, score, 1.0 FROM ({KEYWORD}) UNION ALL SELECT 'text', 'item', target, level, score, 1.2 FROM ({EVASION})), tg AS (SELECT 'item' AS target_kind, item_id AS target FROM d), {_judged('h1', 'a1')} SELECT {SHOWN} FROM a1""")
def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _assessed(_text_assessed(spark, folder))


def _text_assessed(spark: SparkSession, folder: str) -> DataFrame:
    data = tables.documents(spark, folder)
    hits = _hits("text.template", data)
    for name in ("text.repetition", "text.keyword", "text.evasion"):
        hits = hits.unionByName(_hits(name, data))
    pipeline = Pipeline(Config.default(), LATIN)
    targets = data.items.select(F.lit("item").alias("target_kind"), F.col("item_id").alias("target"))
    return pipeline.scorer.levels(hits, targets)


# ---- evaluation ----


@query("confusion_matrix", f"""WITH {RATIO}, s AS ({TEMPLATE}), gold AS (SELECT doc_id::VARCHAR AS target, bool_or(quality = 0) AS positive FROM labels GROUP BY ALL), x AS (SELECT d.item_id, coalesce(positive, false) AS is_gold, s.target IS NOT NULL AND least(100.0, s.score * CASE s.level WHEN 'strong' THEN 1.5 ELSE 1.0 END * 0.9 * 25) >= 20 OR coalesce(s.level, '') = 'strong' AS said
  FROM d LEFT JOIN s ON s.target = d.item_id LEFT JOIN gold ON gold.target = d.item_id)
SELECT count(*) FILTER (is_gold AND said) AS tp, count(*) FILTER (NOT is_gold AND said) AS fp, count(*) FILTER (is_gold AND NOT said) AS fn, count(*) FILTER (NOT is_gold AND NOT said) AS tn FROM x""")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    data = tables.documents(spark, folder)
    targets = data.items.select(F.lit("item").alias("target_kind"), F.col("item_id").alias("target"))
    found = Pipeline(Config.default(), LATIN).scorer.levels(_hits("text.template", data), targets)
    labels = tables.table(spark, folder, "labels").groupBy(F.col("doc_id").cast("string").alias("target")).agg(F.max(F.col("quality") == 0).alias("positive"))
    return evaluate.confusion(found, labels, "item")


@query("group_purity", f"""WITH {PASS1}, {PROPAGATED}, gold AS (SELECT user_id::VARCHAR AS actor, max(value) > 200 AS positive FROM events GROUP BY user_id)
SELECT 'coordination.burst' AS signal, bh.target, count(*) AS size, count(*) FILTER (positive) AS fake, round(count(*) FILTER (positive) / count(*), 6) AS purity
FROM bh JOIN a1 ON a1.target_kind = 'group' AND a1.target = bh.target AND a1.level <> 'clean' JOIN pm ON pm.topic = bh.topic AND r <= 30 JOIN gold USING (actor) GROUP BY bh.target""")
def group_purity(spark: SparkSession, folder: str) -> DataFrame:
    gold = tables.table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("target")).agg((F.max("value") > 200).alias("positive"))
    return evaluate.group_purity(_pass1(spark, folder), gold).withColumn("purity", F.round("purity", 6))
