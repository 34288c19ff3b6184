import pytest
from pyspark.sql import functions as F

from murmuration.config import Config
from murmuration.functions import text as T
from murmuration.operators.hits import Context, build_signals
from murmuration.operators.kernels import anchors, greedy_clusters, label_propagation, longest_common_segment, shares_run, simhash
from murmuration.plans.evaluate import prf
from murmuration.plans.pipeline import Pipeline
from murmuration.plans.scoring import Scorer
from murmuration.sources.dataset import Dataset
from murmuration.sources.fieldmap import Adapter, FieldMap
from murmuration.sources.rules import RuleBook

BASE = 1756728000


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_normalize_and_fold(spark):
    assert one(spark, T.normalize, "  Ａｂ１​　x\t\ty\r\n\n\n\nz，。 ") == "Ab1 x y\n\nz，。"
    assert one(spark, lambda c: T.fold(c, {"薇": "微", "➕": "加"}), "加➕薇❤️ 信V🙂") == "加加微信v"
    assert one(spark, T.normalize, None) == ""


def test_tokens_and_measures(spark):
    assert one(spark, T.tokens, "这个 好") == ["这个", "个好"]
    assert one(spark, T.tokens, "好") == ["好"] and one(spark, T.tokens, "") == []
    assert one(spark, T.max_run, "哈哈哈哈哈") == 5
    top = one(spark, T.top_char, "abcab")
    assert (top.n, top.char) == (2, "a")
    assert one(spark, lambda c: T.entropy(F.split(c, " ")), "a b a b") == pytest.approx(1.0)
    assert one(spark, lambda a, b: T.shares_run(a, b, 0.5), "xxabcd", "abcdyy") is True
    assert one(spark, lambda c: T.repeat_ratio(F.split(c, " "), 3), "a b c a b c a b c") == pytest.approx(1 - 3 / 7)


def test_kernels():
    assert longest_common_segment("abcdefg", "zzcdez") == (3, 2, 2) or longest_common_segment("abcdefg", "zzcdez")[0] == 3
    assert shares_run("abcd", "xxabcd", 0.5) and not shares_run("abcd", "wxyzuv", 0.5) and not shares_run("", "a", 0.5)
    assert greedy_clusters([(1, 2), (1, 3), (2, 3), (4, 5)], 3) == [(1, 1), (1, 2), (1, 3)]
    assert label_propagation([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")]) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert simhash([]) == 0
    import random

    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        if shares_run(a, b, 0.5):
            assert set(anchors(a, 0.5)) & set(anchors(b, 0.5)), (a, b)


def test_adapter(spark):
    records = [
        {"id": 1, "who": {"n": "a"}, "body": " hi ", "at": "2023-09-01T00:00:00Z", "topic": 0, "likes": "3.7"},
        {"id": 2, "who": {"n": "a"}, "body": "   "}, "no record", {"who": {"n": ""}, "body": "x", "likes": 3.7, "actor_has_avatar": None},
    ]
    a = Adapter(FieldMap(item_id="id", text="body", actor_id="who.n", created_at="at"))
    data = a.load(spark, records)
    found = data.items.orderBy("seq").collect()
    assert [(r.actor_id, r.text, r.topic, r.likes) for r in found] == [("a", "hi", "", 0), ("unknown", "x", "", 3)]
    assert found[0].item_id == "1" and found[1].item_id.startswith("auto-")
    assert [r.actor_id for r in data.actors.collect()] == ["a"]


def items(spark, data):
    return Dataset.of(spark.createDataFrame([(i, str(i), a, t, BASE + s, topic) for i, (a, t, s, topic) in enumerate(data)], "seq long, item_id string, actor_id string, text string, at long, topic string").withColumn("created_at", F.timestamp_seconds("at")).drop("at"))


def hits(spark, name, data, **params):
    signal = next(s for s in build_signals(Config.default()) if s.name == name)
    return signal.plan(Context(data, RuleBook.load(), Config.default().signal_cfg(name) | params)).collect()


def test_text_signals(spark):
    data = items(spark, [("a", "有需要的加微信详聊", 0, "t"), ("b", "有需要的加薇❤️信详聊", 1, "t"), ("c", "哈" * 16, 2, "t"), ("d", "这个方法好用" * 4, 3, "t"), ("e", "今天天气不错，我们去公园走走吧", 4, "t")])
    assert [(h.target, h.level) for h in hits(spark, "text.evasion", data)] == [("1", "strong")]
    assert {h.target for h in hits(spark, "text.repetition", data)} == {"2"}
    assert "3" in {h.target for h in hits(spark, "text.template", data)}
    assert {h.target for h in hits(spark, "text.keyword", data)} == {"0"}


def test_group_signals(spark):
    background = [(f"u{i}", f"background {i}", i * 180, "t") for i in range(40)]
    burst = [(f"f{i}", f"short text number {i}", 9000 + 2 * i, "b") for i in range(8)]
    found = hits(spark, "coordination.burst", items(spark, background + burst))
    assert [h.target.split(":")[1] for h in found] == ["b"] and len(found[0].members) == 8
    same = items(spark, [(f"f{i}", "exactly the same sentence here", i, "t") for i in range(3)])
    assert [len(h.members) for h in hits(spark, "coordination.cluster", same)] == [3]
    gang = items(spark, [(f"g{i}", "x", 0, f"t{j}") for i in range(4) for j in range(4)])
    assert [h.target for h in hits(spark, "coordination.cooccur", gang)] == ["cooccur:g0"]


def test_scoring_and_propagation(spark):
    scorer = Scorer.of(Config.default())
    schema = "signal string, kind string, target string, target_kind string, level string, score double, weight double, reason string, evidence string, members array<string>"
    rows = [("t", "text", "x", "item", "weak", 1.0, 1.0, "", "{}", None), ("a", "account", "y", "actor", "strong", 0.1, 1.0, "", "{}", None)]
    found = {r.target: r for r in scorer.assess(spark.createDataFrame(rows, schema), spark.createDataFrame([("item", "z")], "target_kind string, target string")).collect()}
    assert (found["x"].score, found["x"].level) == (22.5, "weak")
    assert found["y"].promoted and found["y"].level == "weak" and found["z"].level == "clean"
    burst = [(f"u{i}", f"background {i}", i * 180, "t") for i in range(40)] + [(f"f{i}", f"short text number {i}", 9000 + 2 * i, "b") for i in range(8)]
    result = Pipeline().run(items(spark, burst))
    assert {r.target for r in result.hits.filter("signal = 'coordination.burst#member'").collect()} == {f"f{i}" for i in range(8)}
    assert result.summary["flagged_by_kind"]["group"] >= 1


def test_config_and_metrics():
    cfg = Config.default("signals.text.template.weak=0.1")
    assert cfg.get("signals.text.template.weak") == 0.1 and cfg.fingerprint() != Config.default().fingerprint()
    assert prf(2, 1, 2) == pytest.approx((2 / 3, 1 / 2, 4 / 7)) and prf(0, 0, 0) == (0.0, 0.0, 0.0)
