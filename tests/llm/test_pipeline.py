import corpus_pipeline
import pytest

from tracegauge.llm import near_dedup, packing

from . import cases

SF = "/root/testdata/sf0.001"
#: Enough labels to learn from.
LARGER = "/root/testdata/sf0.01"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "exact dedup", "near dedup", "packing"]


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    n, was = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, was, LARGER).cache()
        assert out.columns == docs.columns, name
        assert out.count() > 0.6 * n, name
        assert out.join(docs, docs.columns, "left_anti").count() == 0
        was = out
    clean = spark.read.parquet(f"{LARGER}/labels.parquet").where("toxic = 0 and quality = 1").join(docs, "doc_id", "left_semi").select("doc_id")
    first = corpus_pipeline.drop_toxic(spark, docs, LARGER)
    assert clean.join(first, "doc_id", "left_anti").count() <= 0.01 * clean.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, stage):
    odd = cases.documents(spark, extra=True)
    out = stage(spark, odd, SF)
    assert out.count() >= 0
    if stage is not corpus_pipeline.pack:
        assert out.columns == odd.columns
    empty = spark.createDataFrame([], cases.SCHEMA)
    assert stage(spark, empty, SF).count() == 0


def test_exact_stage_keeps_one_of_each(spark):
    docs = cases.documents(spark)
    out = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r["text"]) for r in out.collect()) == sorted({norm(r[1]) for r in cases.rows()})


def test_near_stage(spark):
    data = [r for r in cases.rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    want = {c for d, n, c in cases.near_components(data, 5, 80).values() if n} | {d for d, n, _ in cases.near_components(data, 5, 80).values() if not n}
    out = near_dedup.keep_first(cases.documents(spark, data=data), 5, 80)
    assert {r["doc_id"] for r in out.collect()} == want


def test_run_packs_all_that_is_kept(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == packing.NAMES and out.count() > 0
