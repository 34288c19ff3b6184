"""Command line: scan, signals, rules, doctor, sample. Exit codes: 0 done, 1 a check failed, 2 wrong input, 3 an unexpected
error, 130 interrupted."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import platform
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

from murmuration import __version__
from murmuration.config import Config


OK, WARN, FAIL = "ok", "warn", "fail"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="murmuration", description="Finds coordinated behaviour in posts and accounts.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="assess the records of a JSON-lines file")
    scan.add_argument("data")
    scan.add_argument("--adapter", choices=("canonical", "nested", "flat"), default="canonical")
    scan.add_argument("--format", choices=("text", "json", "markdown"), default="text")
    scan.add_argument("--json", dest="format", action="store_const", const="json", help="same as --format json")
    scan.add_argument("--limit", type=int, default=20, help="0: all")
    scan.add_argument("--min-level", choices=("clean", "weak", "strong"), default="weak")
    scan.add_argument("--evidence", action="store_true")
    scan.add_argument("--out", help="a Markdown report")
    sub.add_parser("signals", help="the enabled signals")
    sub.add_parser("rules", help="counts of the rule book")
    sub.add_parser("doctor", help="checks of the installation")
    sample = sub.add_parser("sample", help="write synthetic records with known groups")
    sample.add_argument("out")
    sample.add_argument("--labelled", action="store_true")
    # settings may stand on both sides of the command
    for command, dest in [(p, "before"), *((c, "after") for c in sub.choices.values())]:
        command.add_argument("--set", action="append", default=[], dest=f"overrides_{dest}", metavar="PATH=VALUE")
        command.add_argument("--config", dest=f"config_{dest}")
    return p


def settings(args: argparse.Namespace) -> Config:
    return Config.load(args.config_after or args.config_before, [*args.overrides_before, *args.overrides_after])


def scan(args: argparse.Namespace) -> int:
    from murmuration.plans import report
    from murmuration.plans.pipeline import Pipeline
    from murmuration.plans.scoring import flagged
    from murmuration.session import drop_written, session
    from murmuration.sources.platforms import any_adapter

    cfg = settings(args)
    if "://" not in args.data and not Path(args.data).exists():
        print(f"no such file: {args.data}", file=sys.stderr)
        return 2
    spark = session()
    data = any_adapter(args.adapter).load(spark, args.data)
    if data.items.isEmpty():
        print("no valid record: does the adapter fit?", file=sys.stderr)
        return 2
    result = Pipeline(cfg).run(data)
    if args.format == "json":
        print(report.render_json(flagged(result.assessments, args.min_level), limit=args.limit))
    elif args.format == "markdown":
        print(report.render_markdown(result.assessments, result.meta, args.limit))
    else:
        s, m = result.summary, result.meta
        print(f"read {m['items']} items, {m['actors']} actors, {m['topics']} topics from {args.data}")
        print(f"assessed {s['assessed']}: {s['clean']} clean, {s['weak']} weak, {s['strong']} strong; {s['no_signal']} without any signal\n")
        print(report.render_text(result.assessments, args.limit, args.min_level, args.evidence))
    if args.out:
        try:
            Path(args.out).parent.mkdir(parents=True, exist_ok=True)
            Path(args.out).write_text(report.render_markdown(result.assessments, {"input": args.data, **result.meta, "version": __version__}), encoding="utf-8")
        except OSError as e:
            print(f"the report can't be written: {e}", file=sys.stderr)
            return 2
        print(f"report written to {args.out}", file=sys.stderr)
    drop_written(spark)
    return 0


PROBE = [
    {"item_id": "probe-1", "actor_id": "a", "text": "需要的加薇❤️信详聊，手机 13800138000", "topic": "t", "created_at": 1756728000},
    {"item_id": "probe-2", "actor_id": "b", "text": "今天去河边散步，风很舒服。", "topic": "t", "created_at": 1756728600},
]


def checks(args: argparse.Namespace) -> Iterator[tuple[str, str, str]]:
    """(name, ok or warn or fail, detail) of each part, up to a run of two records of which one is bad."""
    from murmuration.operators.hits import REGISTRY, build_signals
    from murmuration.plans.pipeline import Pipeline
    from murmuration.plans.scoring import flagged
    from murmuration.session import session, shared_dir
    from murmuration.sources.fieldmap import Adapter
    from murmuration.sources.rules import RuleBook

    yield "python", OK, platform.python_version()
    try:
        cfg = settings(args)
        yield "settings", OK, cfg.fingerprint()
    except (FileNotFoundError, ValueError) as e:
        yield "settings", FAIL, str(e)
        return
    folder = cfg.get("corpus.rules_dir") or None
    book = RuleBook.load(folder)
    stats = book.stats()
    detail = ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in stats.items())
    if folder and not Path(folder).is_dir():
        yield "rules", FAIL, f"no folder {folder}"
    elif not stats["phrases"]:
        yield "rules", FAIL, f"no phrases, so no text will match: {detail}"
    else:
        yield "rules", OK if all(stats.values()) else WARN, detail
    enabled = build_signals(cfg)
    yield "signals", OK if len(enabled) >= 8 else WARN, f"{len(enabled)} of {len(REGISTRY)} enabled"
    yield "segmenter", OK, "jieba" if importlib.util.find_spec("jieba") else "none, pairs of characters are used"
    try:
        spark = session()
        yield "spark", OK, f"{spark.version}, {spark.sparkContext.master}"
        yield "shared folder", OK, shared_dir(spark)
        found = {r.target for r in flagged(Pipeline(cfg, book).run(Adapter().load(spark, PROBE)).assessments).collect()}
    except Exception as e:  # noqa: BLE001 - the check reports whatever fails
        yield "probe", FAIL, f"{type(e).__name__}: {str(e)[:200]}"
        return
    if "probe-1" not in found:
        yield "probe", FAIL, "the bad record isn't found"
    else:
        yield "probe", WARN if "probe-2" in found else OK, f"flagged {', '.join(sorted(found))}"


def display_width(text: str) -> int:
    """Columns of a terminal: wide characters take two."""
    return sum(1 + (unicodedata.east_asian_width(c) in ("W", "F")) for c in text)


def padded(text: str, width: int) -> str:
    return text + " " * (width - display_width(text))


def doctor(args: argparse.Namespace) -> int:
    found = list(checks(args))
    width = max(display_width(name) for name, _, _ in found)
    for name, state, detail in found:
        print(f"[{state}] {padded(name, width)}  {detail}")
    worst = max((state for _, state, _ in found), key=(OK, WARN, FAIL).index)
    print(f"result: {worst}")
    return int(worst == FAIL)


def run(args: argparse.Namespace) -> int:
    if args.command == "scan":
        return scan(args)
    if args.command == "doctor":
        return doctor(args)
    if args.command == "sample":
        from murmuration.sources.synthetic import records

        keep = lambda k: args.labelled or k not in ("group", "is_synthetic_positive")
        lines = [json.dumps({k: v for k, v in r.items() if keep(k)}, ensure_ascii=False) for r in records()]
        Path(args.out).write_text("\n".join(lines) + "\n", encoding="utf-8")
        print(f"{len(lines)} records written to {args.out}")
        return 0
    cfg = settings(args)
    if args.command == "signals":
        from murmuration.operators.hits import build_signals

        for s in build_signals(cfg):
            print(f"{s.name:<26} {cfg.signal_cfg(s.name)['weight']:<5} {s.description}")
    else:
        from murmuration.sources.rules import RuleBook

        print(json.dumps(RuleBook.load(cfg.get("corpus.rules_dir") or None).stats(), indent=2))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    except ValueError as e:
        print(f"wrong settings: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - the last stop before the shell
        print(f"unexpected {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        print("`python -m murmuration doctor` shows what is wrong; set MURMURATION_DEBUG=1 for the traceback", file=sys.stderr)
        if os.environ.get("MURMURATION_DEBUG"):
            raise
        return 3


if __name__ == "__main__":
    sys.exit(main())
