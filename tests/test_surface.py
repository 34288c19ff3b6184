"""What users touch first: command line, reports, records in and out, platform exports, labelled evaluation, streams."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from murmuration import cli
from murmuration.config import Config
from murmuration.operators.hits import REGISTRY, build_signals
from murmuration.plans import evaluate, report
from murmuration.plans.pipeline import Pipeline
from murmuration.sources import platforms, records, synthetic
from murmuration.sources.fieldmap import Adapter
from murmuration.sources.rules import RuleBook

TALK = {"item_id": "n1", "actor_id": "u1", "actor_name": "一般人", "text": "今天把阳台的花都浇了一遍，等着秋天开。", "created_at": 1756728000, "topic": "t"}
OFFER = {"item_id": "s1", "actor_id": "u2", "actor_name": "用户9472961", "text": "想要的加薇❤️信，私❤️信我，名额不多", "created_at": 1756728060, "topic": "t", "actor_created_at": 1756700000, "actor_has_avatar": False, "actor_default_name": True, "actor_followers": 0, "actor_following": 363}


@pytest.fixture
def data_file(tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in (TALK, OFFER)) + "\n", encoding="utf-8")
    return str(path)


def test_scan_prints_and_writes_reports(spark, data_file, tmp_path, capsys):
    out = tmp_path / "new" / "report.md"
    assert cli.main(["scan", data_file, "--out", str(out), "--evidence"]) == 0
    shown = capsys.readouterr().out
    assert "read 2 items, 2 actors, 1 topics" in shown and "text.evasion" in shown and "一般人" not in shown
    written = out.read_text(encoding="utf-8")
    assert written.startswith("# Report") and "assessed: 4" in written and "data.jsonl" in written
    assert cli.main(["--set", "signals.text.evasion.enabled=false", "scan", data_file, "--json", "--limit", "0", "--set", "signals.text.keyword.enabled=false"]) == 0
    rows = json.loads(capsys.readouterr().out)
    assert rows and all({"target", "level", "hits", "breakdown", "level_label"} <= set(r) for r in rows)
    assert not any(h["signal"].startswith(("text.evasion", "text.keyword")) for r in rows for h in r["hits"])


def test_scan_of_wrong_input(spark, tmp_path, capsys, monkeypatch):
    empty = tmp_path / "empty.jsonl"
    empty.write_text('{"text": " "}\n', encoding="utf-8")
    assert cli.main(["scan", str(tmp_path / "none.jsonl")]) == 2 and "no such file" in capsys.readouterr().err
    assert cli.main(["scan", str(empty)]) == 2 and "no valid record" in capsys.readouterr().err
    assert cli.main(["--set", "no equals sign", "signals"]) == 2 and "wrong settings" in capsys.readouterr().err
    assert cli.main(["signals", "--config", str(tmp_path / "none.yaml")]) == 2
    monkeypatch.setattr(cli, "run", lambda args: 1 / 0)
    assert cli.main(["signals"]) == 3 and "ZeroDivisionError" in capsys.readouterr().err
    monkeypatch.setattr(cli, "run", lambda args: (_ for _ in ()).throw(KeyboardInterrupt))
    assert cli.main(["signals"]) == 130
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0


def test_signals_rules_and_doctor(spark, tmp_path, capsys):
    assert cli.main(["signals"]) == 0 and len(capsys.readouterr().out.splitlines()) == 10
    assert cli.main(["rules"]) == 0
    assert json.loads(capsys.readouterr().out) == {"phrase_groups": 5, "phrases": 55, "fold_entries": 21, "regex_rules": 7, "stopwords": 119}
    assert cli.main(["doctor"]) == 0
    assert "[ok] probe" in capsys.readouterr().out
    assert cli.main(["doctor", "--set", f"corpus.rules_dir={tmp_path}"]) == 1
    shown = capsys.readouterr().out
    assert "[fail] rules" in shown and "result: fail" in shown
    assert cli.display_width("宽ab") == 4 and cli.padded("宽", 4) == "宽  "


def test_reports(spark):
    hit = lambda signal, score, level, **evidence: (signal, signal.split(".")[0], "x|y", "item", level, score, 1.0, f"reason | {signal}", json.dumps(evidence), None)
    schema = "signal string, kind string, target string, target_kind string, level string, score double, weight double, reason string, evidence string, members array<string>"
    rows = [hit("text.template", 0.4, "weak"), hit("coordination.burst", 0.9, "weak", long="e" * 400), hit("text.keyword", 0.8, "strong", a=1)]
    targets = spark.createDataFrame([("item", "x|y"), ("item", "calm")], "target_kind string, target string")
    found = Pipeline().scorer.assess(spark.createDataFrame(rows, schema), targets, spark.createDataFrame([("x|y", "a\nlabel|")], "target string, label string"))
    want = 25 * (0.4 * 0.9 + 0.9 * 1.3 + 0.8 * 1.5 * 0.9) + 8
    (first, calm) = json.loads(report.render_json(found))
    assert (first["score"], first["bonus"], first["level"], calm["score"], calm["hits"]) == (round(want, 2), 8.0, "strong", 0, [])
    assert [h["signal"] for h in first["hits"]] == ["coordination.burst", "text.keyword", "text.template"]
    assert {b["signal"]: b["contribution"] for b in first["breakdown"]} == {"text.template": 9.0, "coordination.burst": 29.25, "text.keyword": 27.0}
    text = report.render_text(found, evidence=True)
    assert text.index("text.keyword") < text.index("text.template") < text.index("coordination.burst") and "+8.0 (2 layers)" in text
    assert max(map(len, (x for x in text.splitlines() if "eeee" in x))) == 240 + 10
    assert report.render_text(found.filter("target = 'calm'"), least="weak").startswith("No suspicious")
    markdown = report.render_markdown(found, {"k|": "v"})
    assert "| k\\| | v |" in markdown and "a label\\|" in markdown and "reason \\| text.keyword" in markdown
    assert report.summarize(found)["flagged_by_kind"] == {"item": 1, "actor": 0, "group": 0}
    assert {json.loads(r.value)["target"] for r in report.json_rows(found).collect()} == {"x|y", "calm"}


def test_json_lines_in_and_out(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text('\n{"text": "a", "n": 1}\nnot json\n  {"text": "b"}  \n[1]\n', encoding="utf-8")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        rows = records.read_jsonl(spark, str(path)).orderBy("seq").collect()
    assert [r.seq for r in rows] == [1, 3] and any("[3, 5]" in str(w.message) for w in caught)
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    out = str(tmp_path / "out")
    assert records.write_jsonl(df, out, single=True) == 2 and records.write_jsonl(df, out, append=True) == 2
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"a":1,"b":"é"}'] * 2 + ['{"a":2}'] * 2
    with pytest.raises(TypeError):
        records.from_dicts(spark, 42)


def test_order_over_files_and_blocks(spark, tmp_path):
    for name, n in (("a", 300), ("b", 5), ("c", 170)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i:05d}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = records.with_order(spark.read.text(f"{tmp_path}/*.txt")).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(475))
    assert [r.value for r in rows] == [f"{name}{i:05d}" for name, n in (("a", 300), ("b", 5), ("c", 170)) for i in range(n)]


def test_adapter_labels_and_fields(spark):
    data = Adapter().load(spark, [{"text": ""}, {"text": "ok", "mentions": 12345, "likes": "no number"}, "text", None])
    item = data.items.first()
    assert data.source == "mapped(skipped=3)" and item.mentions == [] and item.likes == 0 and item.topic == ""
    assert Adapter().load(spark, [{"text": "x", "mentions": "@a"}]).items.first().mentions == ["@a"]
    nested = platforms.nested_comments().load(spark, [{"rpid": 7, "oid": 5, "ctime": 1756728000, "like": 3, "member": {"mid": 9, "uname": "n"}, "content": {"message": "hi"}}, {}])
    row = nested.items.first()
    assert (nested.source, row.item_id, row.actor_id, row.topic, row.likes, row.text) == ("bilibili", "7", "9", "5", 3, "hi")
    flat = platforms.flat_comments().load(spark, [{"cid": "1", "text": "hi", "user": {"uid": 2, "nickname": "n"}, "create_time": 1756728000, "aweme_id": "v", "digg_count": 4, "reply_id": "0"}])
    assert flat.source == "mapped" and flat.actors.first().name == "n"


def test_danmaku(spark, tmp_path):
    xml = '<i>\n<d p="1.5,1,25,0,1756728000,0,ab12,99">first &amp; last</d>\n<d p="bad">x</d>\n<d p="2,1,25,0,1756728001,0,,98"> second </d><d p="3,1,25,0,1,0,z,9">  </d>\n</i>'
    path = tmp_path / "room.xml"
    path.write_text(xml, encoding="utf-8")
    for source, topic in ((str(path), "room"), (xml, "")):
        data = platforms.load_danmaku(spark, source)
        rows = data.items.orderBy("seq").collect()
        assert [(r.actor_id, r.text, r.topic) for r in rows] == [("ab12", "first & last", topic), ("unknown", "second", topic)]
        assert data.source == "bilibili:danmaku" and rows[0].created_at.year == 2025


def test_synthetic_corpus_is_told_apart(spark, tmp_path):
    """End to end on labelled data: every pattern is found by the signal meant for it, and few others are."""
    path = tmp_path / "labelled.jsonl"
    assert cli.main(["sample", str(path), "--labelled"]) == 0
    made = synthetic.records()
    assert len(made) == 193 and len({r["actor_id"] for r in made}) == 160 and len({r["topic"] for r in made}) == 10
    data, items, actors = evaluate.load_labelled(spark, str(path))
    sets = [x for x in evaluate.ABLATIONS if x[0] in ("all", "text", "account")]
    rows = {r["name"]: r for r in evaluate.ablations(data, items, actors, sets=sets)}
    assert len(evaluate.ABLATIONS) == 7 and rows["all"]["signals"] == 10
    everything = rows["all"]
    assert everything["actor"]["recall"] == 1.0 and everything["actor"]["precision"] >= 0.9
    assert everything["item"]["precision"] == 1.0 and sum(everything["levels"].values()) == everything["levels"]["clean"] + everything["levels"]["weak"] + everything["levels"]["strong"]
    assert rows["account"]["actor"]["f1"] == 1.0 and rows["text"]["actor"]["recall"] == 0.0
    groups = {(g["signal"], g["fake"]) for g in everything["groups"] if g["purity"] > 0.7}
    assert {("coordination.cluster", 8), ("coordination.cooccur", 6), ("coordination.burst", 15)} <= groups
    assert len({r["fingerprint"] for r in rows.values()}) == 3
    table = evaluate.render_markdown(list(rows.values()))
    assert table.count("\n| ") == 4 and "| all | 10 |" in table


def test_fixture_of_three_layers(spark):
    base = 1756728000
    rows = [{"text": f"{a}今天在{b}看到的{c}", "actor_id": f"u{i % 6 + 1}", "topic": "normal", "created_at": base + 900 * i} for i, (a, b, c) in enumerate(zip("甲乙丙丁戊己庚辛壬癸子丑", ["河边", "山上", "店里", "车站", "学校", "医院", "公园", "图书馆", "码头", "广场", "工地", "剧院"], ["白鹭", "云海", "新书", "旧站牌", "合唱", "花篮", "风筝", "画册", "渔船", "灯展", "吊车", "海报"]))]
    rows += [{"text": "这款耳机的降噪和续航都让人放心推荐" + s, "actor_id": f"f{i + 1}", "topic": "copied", "created_at": base + 60 * i} for i, s in enumerate(("", "的", "。"))]
    rows += [{"text": ("路灯亮了", "刚下班", "谁带伞了", "今晚吃面", "球进了", "堵在桥上", "猫又跑了", "明天见")[i], "actor_id": f"f{i + 4}", "topic": "crowd", "created_at": base + 5 * i} for i in range(8)]
    fake = {"actor_has_avatar": False, "actor_default_name": True, "actor_followers": 0, "actor_following": 500, "actor_created_at": base - 400 * 86400}
    result = Pipeline().run(Adapter().load(spark, [r | (fake if r["actor_id"].startswith("f") else {}) for r in rows]), profile=True)
    hits = result.hits.collect()
    by = lambda name: [h for h in hits if h.signal == name]
    assert [sorted(h.members) for h in by("coordination.cluster")] == [["f1", "f2", "f3"]] and len(by("coordination.burst")[0].members) == 8
    assert {h.target for h in by("account.profile")} == {f"f{i}" for i in range(1, 12)}
    assert {"f1"} <= {h.target for h in by("coordination.cluster#member")} and {"f4"} <= {h.target for h in by("coordination.burst#member")}
    assert set(result.timings) == {s.name for s in build_signals(Config.default())} == set(REGISTRY)
    assert not result.flagged().filter("target_kind = 'item' and label like '%今天在%'").count()


def test_members_beyond_those_shown(spark):
    rows = [{"text": "一模一样的一句话放在这里", "actor_id": f"a{i:03d}", "topic": "t", "created_at": 1756728000 + 400 * i} for i in range(45)]
    data = Adapter().load(spark, rows)
    for override, n in ((), 30), (("signals.coordination.cluster.max_members=null",), 45):
        p = Pipeline(Config.default(*override))
        (hit,) = p.hits_of(data, next(s for s in p.signals if s.name == "coordination.cluster")).collect()
        assert len(hit.members) == n and len(json.loads(hit.evidence)["actors"]) == 30


def test_rule_books(tmp_path):
    assert RuleBook.load(tmp_path) == RuleBook.empty()
    (tmp_path / "phrases.yaml").write_text("groups: [{tag: a, weight: 0.5, phrases: [' One ', two]}, {phrases: [three]}]")
    (tmp_path / "evasion.yaml").write_text("fold: {é: e}")
    (tmp_path / "patterns.yaml").write_text("rules: [{tag: a, weight: 0.9, pattern: '[0-9]+'}, {tag: b, pattern: '('}]")
    (tmp_path / "stopwords.txt").write_text("# none\nthe an\n")
    book = RuleBook.load(tmp_path)
    assert book.stats() == {"phrase_groups": 2, "phrases": 3, "fold_entries": 1, "regex_rules": 1, "stopwords": 2}
    assert (book.weight("a"), book.regex_weight("a"), book.weight("none"), book.patterns[0]) == (0.5, 0.9, 1.0, ("one", "a"))


def test_config_paths(monkeypatch, tmp_path):
    cfg = Config({"a": {"b": 1, "c": {}}, "l": [1, {"x": 2}]})
    assert cfg.get("a") == {"b": 1, "c": {}} and cfg.get("a.b") == 1 and cfg.get("a.b.c", 5) == 5 and cfg.get("l") == [1, {"x": 2}]
    cfg.set("a.b.deep", 3)
    assert cfg.to_dict()["a"] == {"b": {"deep": 3}, "c": {}} and cfg.require("a.b.deep") == 3 and cfg.section("l") == {}
    with pytest.raises(KeyError):
        cfg.require("none")
    monkeypatch.setenv("MURMURATION__SCORING__CAP", "55")
    assert Config.load().get("scoring.cap") == 55 and Config.load(overrides=["scoring.cap=66"]).get("scoring.cap") == 66
    (tmp_path / "c.yaml").write_text("signals: {text: {keyword: {weight: 2}}}")
    only = Config.load(tmp_path / "c.yaml")
    assert [n for n, _ in only.iter_signals()] == ["text.keyword"] and only.signal_cfg("text.keyword") == {"enabled": True, "weight": 2}
    assert only.with_overrides("a=1").get("a") == 1 and only.get("a") is None


def test_segmenter(spark):
    from murmuration.functions import text as T

    row = spark.createDataFrame([(" ａ b  the ",)], "t string").select(T.words(F.col("t"), lambda t: t.split(" "), {"the"}).alias("w"), T.words(F.col("t")).alias("p")).first()
    assert row.w == ["a", "b"] and row.p in (["ab", "bt", "th", "he"], ["a", "b", "the"])


def test_streams(spark, tmp_path):
    from murmuration.streaming.live import live_bursts, read_items, text_hits

    rows = [OFFER, TALK] + [{"item_id": f"b{i}", "actor_id": f"a{i}", "text": f"text {i}", "topic": "hot", "created_at": 1756730000 + 2 * i} for i in range(9)]
    rows.append({"text": "much later", "created_at": 1756830000, "actor_id": "z"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("broken\n" + "\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    items = read_items(spark, f"{tmp_path}/in")
    for name, df in (("hits", text_hits(items)), ("bursts", live_bursts(items))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert {(r.signal, r.target) for r in spark.table("hits").collect()} >= {("text.evasion", "s1")}
    found = spark.table("bursts").collect()
    assert found and {r.topic for r in found} == {"hot"} and max(r.n for r in found) == 9
