"""The pipeline: each stage does to its own input what its operator says."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from halyard.llm import decontaminate, lines, minhash, quality
from tests.llm.helpers import odd
from tests.llm.test_texts import check_packing

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    at = docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in at.collect()}
        stage(spark, at, SF).write.parquet(str(tmp_path / str(i)))
        got = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert got.columns == docs.columns
        kept = {r["doc_id"] for r in got.select("doc_id").collect()}
        if name == "quality classifier":
            assert kept == {r["doc_id"] for r in quality.score_quality(at, labels).filter("good = 1").collect()}
        elif name == "line dedup":
            whole = {r["doc_id"]: r["text"] for r in lines.dedup_lines(at).collect()}
            assert got.count() < at.count() or sum(map(len, whole.values())) < sum(map(len, before.values()))
            assert {r["doc_id"]: r["text"] for r in got.collect()} == {d: t for d, t in whole.items() if t == before[d] or t.strip()}
        elif name == "near-duplicates":
            assert kept == {r["doc_id"] for r in minhash.near_duplicates(at).filter("kept").collect()} and got.count() == len(kept)
        elif name == "decontamination":
            assert kept == {r["doc_id"] for r in decontaminate.contamination(at, bench).filter("not contaminated").collect()}
        else:
            assert check_packing(got.collect(), before, 2048) > 0.95
        at = got
    assert pipeline.run(spark, SF).count() == at.count()


def test_odd_rows(spark):
    at = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        at = stage(spark, at, SF)
    at.collect()


def test_empty_tables_and_further_columns(spark):
    none = at = odd(spark).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    extra = "row row2 key label bins found n_removed_lines n_words root id _r _r2 _d _ats".split()
    wide = odd(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for _, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == none.columns and at.count() == 0
        kept = stage(spark, wide, SF)
        assert kept.columns == wide.columns and {tuple(r[c] for c in extra) for r in kept.collect()} <= {tuple(range(len(extra)))}
    assert pipeline.STAGES[-1][1](spark, at, SF).count() == 0


def test_repeated_rows_and_ties(spark):
    """Rows that repeat are decided alike, and of a tie for the least id one row stays."""
    text = "the same sentence of many common words stands in every one of these rows and is read as one"
    docs = spark.createDataFrame([(d, text + t, "en", "src1", 99) for d, t in ((4, ""), (4, ""), (2, " again"), (2, ""), (9, ""))], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    assert stages["quality classifier"](spark, docs, SF).count() in (0, 5)
    near = stages["near-duplicates"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in near} == {2} and len({r["text"] for r in near}) == len(near)
    assert stages["decontamination"](spark, docs, SF).count() == 5
    left = stages["line dedup"](spark, docs, SF).collect()
    assert [r["doc_id"] for r in left] == [2]
    assert stages["packing"](spark, docs, SF).count() == 5
