import os
import subprocess
import sys
import time

import pytest

import corpus_pipeline as C
from cairn.llm import decontaminate, quality_rules

from ..conftest import SMALL
from .test_ngram_join import brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, found = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        found[name] = spark.read.parquet(str(tmp_path / name))
        docs = found[name]
        assert name == "packing" or docs.columns == columns
    good = {r.doc_id for r in quality_rules.query(spark, SMALL).where("kept").collect()}
    assert {r.doc_id for r in found["quality_rules"].collect()} == good
    want = brute([(r.doc_id, r.text) for r in found["quality_rules"].collect()])
    assert sorted(r.doc_id for r in found["ngram_join"].collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    left = decontaminate.scan(found["decontamination"], spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert left.where("contaminated").count() == 0
    assert found["pii"].where("text rlike '[0-9]{16}'").join(found["decontamination"], ["doc_id", "text"], "left_semi").count() == 0
    assert {r.doc_id for r in found["packing"].collect()} == {r.doc_id for r in found["pii"].collect()}


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns, long texts and no rows at all."""
    prose = " ".join(f"The word{i} and the thing of it is w{i * 7 % 101}." for i in range(40))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, prose + " None here.", "en", 1), (1, prose.replace("word", "term"), "en", 2), (1, prose.replace("word", "term"), "en", 2), (2, None, None, 3), (3, "", None, 4), (4, prose.replace("word", "mail") + " Write to Ann@example.org, please.", None, None), (5, prose.replace("the", "of the") * 60, "de", 6), (6, item + " " + prose.replace("thing", "ding"), "en", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").selectExpr("doc_id", "text", "lang", "lang AS source", "n_chars", "1 AS kept", "2 AS n_words", "'x' AS component_id", "0 AS rank")
    for docs in (df, df.limit(0)):
        left = {}
        for name, stage in C.STAGES:
            out = stage(spark, docs, SMALL)
            left[name] = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(left[name], docs.schema)
            else:
                assert {r.doc_id for r in left[name]} == {r.doc_id for r in left["pii"]}
        if left["quality_rules"]:
            assert sorted((r.doc_id or 0) for r in left["quality_rules"]) == [0, 1, 1, 4, 6] and not any(item in r.text for r in left["decontamination"])
            assert not any("Ann@example.org" in r.text for r in left["pii"]) and all(r.n_chars == len(r.text) for r in left["pii"])


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
    piece = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert piece(C.run(spark, SMALL)) == piece(docs)


def test_run(spark):
    assert C.run(spark, SMALL).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _kept(spark):
    from pathlib import Path

    return {p for p in Path(C.kernel.shared_dir(spark).removeprefix("file:")).glob("cairn-pipeline-*/*")}


def test_only_the_last_stage_is_kept_and_nothing_after_a_failure(spark, monkeypatch):
    before = _kept(spark)
    C.run(spark, SMALL).count()
    assert [p.name for p in _kept(spark) - before] == ["pii"]

    def fails(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(C, "STAGES", [*C.STAGES[:2], ("fails", fails), *C.STAGES[3:]])
    before = _kept(spark)
    with pytest.raises(RuntimeError):
        C.run(spark, SMALL)
    assert _kept(spark) == before


def test_nothing_is_left_when_the_driver_ends(tmp_path):
    code = f"""
from cairn.session import session
from cairn.streaming import jobs
import corpus_pipeline
s = session("local[2]", **{{"spark.checkpoint.dir": "{tmp_path}/shared", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
docs = s.read.parquet("{SMALL}/documents.parquet").limit(20)
docs.write.parquet("{tmp_path}/in/documents.parquet")
s.read.parquet("{SMALL}/benchmark.parquet").write.parquet("{tmp_path}/in/benchmark.parquet")
corpus_pipeline.run(s, "{tmp_path}/in").count()
jobs.collected(s.readStream.schema(docs.schema).parquet("{tmp_path}/in/documents.parquet"), "append").count()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(C.__file__), env=os.environ | {"PYTHONPATH": os.path.dirname(C.__file__)}, timeout=240)
    left = lambda: list((tmp_path / "shared").glob("*/cairn-*"))
    for _ in range(60):  # the driver's JVM ends after Python has
        if not left():
            break
        time.sleep(0.5)
    assert not left()
