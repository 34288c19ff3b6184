"""The corpus pipeline, stage by stage, against plain Python."""

import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from murmuration.llm import bpe, common, quality  # noqa: E402
from tests.llm.test_files import spans_by_hand  # noqa: E402
from tests.llm.test_near_dedup import all_pairs, copies  # noqa: E402


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(120, 220))]
        if i % 5 == 0:
            words.insert(3, f"token=abcdefghijkl{i}")
        rows.append(" ".join(words))
        if i % 3 == 0:
            rows += [rows[-1].upper(), " ".join(copies(rng, words, 0.01))]
    rows += ["short", "", None, "one two three four five " * 9, rows[0]]
    return [(2**53 + 3 * i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(rows)]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(i % 9 != 0), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    folder = f"file://{tmp_path}"
    # quality: base rules and the fitted trees
    trees = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    kept = []
    for i, text, *_ in rows:
        base, features = quality.statistics(text or "")
        if base[0] >= 10 and 100 * base[4] <= 20 * base[0] and trees.score(np.array([features]))[0] >= 0:
            kept.append((i, text))
    assert 20 < len(kept) < len(rows)
    # equal texts: the largest id stays
    stays = {}
    for i, text in kept:
        stays[text.lower()] = max(stays.get(text.lower(), (i, text)), (i, text))
    kept = sorted(stays.values())
    # near copies: the least id of each class stays
    label, links = all_pairs([t.lower().split() for _, t in kept])
    assert links >= 5
    kept = [kept[k] for k in sorted(set(label))]
    # secrets
    clean = {}
    for i, text in kept:
        out, at = "", 0
        for start, _, end in spans_by_hand(text):
            out, at = out + text[at:start] + "[SECRET]" if start >= at else out, max(at, end)
        clean[i] = out + text[at:]
    assert any("[SECRET]" in t for t in clean.values())
    found = {}
    places = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        assert r.piece == 0 and r.start == 0
        found[r.doc_id] = (r.length, r.ids_crc32)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    encoder = bpe.tokenizer(bpe.default_path())
    want = {}
    for i, text in clean.items():
        ids = encoder.encode(text) + np.array([0], "<u4").tobytes()
        want[i] = (len(ids) // 4, zlib.crc32(ids))
    assert found == want
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and out.count() == 0, name


def test_stages_bound_what_goes_to_python_at_once(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    long_texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality rules", "near-dedup", "best-fit packing"):
            spark.conf.unset(key)
            stage(spark, docs, f"file://{tmp_path}")
            found = long_texts.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in found) == 2000 and max(r.size for r in found) < 1.1 * common.BATCH, name
    spark.conf.unset(key)


def test_released_returns_free_memory():
    kept = []

    def run(numbers):
        for n in numbers:
            parts = [bytes(1000) for _ in range(n)]
            kept.append(parts[-1])  # what lies below stays with the process otherwise
            yield len(parts)

    def mb():
        return int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    assert list(common.released(run)(iter([]))) == []  # what tests before left
    before, it = mb(), common.released(run)(iter([100_000]))
    assert next(it) == 100_000 and mb() - before > 80
    assert list(it) == [] and mb() - before < 30
