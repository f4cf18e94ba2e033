"""The pipeline's stages, each judged on its own input, and the registered queries."""

import inspect

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute_components, middle_holders
from weft.llm import decontam, quality, registry, substring_dedup
from weft.sources.files import read_table

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    registry.load_all()
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "source_mix"]
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]


def test_stages(spark, tmp_path):
    documents = docs = read_table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs, after)
        docs = after
    for name, (_, after) in list(kept.items())[:-1]:
        assert after.schema == documents.schema, name

    before, after = kept["quality_rules"]
    want = {r.doc_id for r in quality.score_quality(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == want

    before, after = kept["near_duplicates"]
    _, component = brute_components([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in component.items() if i == c)
    assert after.count() < before.count()

    before, after = kept["repeated_passages"]
    hit = {r.doc_id for r in substring_dedup.passages(before).collect()}
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        if r.doc_id not in hit:
            assert texts[r.doc_id] == r.text
        elif r.doc_id in texts:
            assert len(texts[r.doc_id]) < len(r.text)

    before, after = kept["benchmark_leaks"]
    items = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        if any(t in r.text for t in items):
            assert r.doc_id not in left
    clean = decontam.contaminated(before, read_table(spark, SF, "benchmark")).select("doc_id").distinct()
    assert before.count() - len(left) == clean.count()

    before, after = kept["source_mix"]
    rows = after.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 100 for r in rows)


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert got.count() > 0


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_nulls_clashing_columns_and_empty_tables(spark, docs, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert stage(spark, empty, SF).collect() == []


def test_passages_of_a_middle_holder_go(spark):
    """A passage goes whichever earlier document holds it."""
    rows, need = middle_holders(6)
    stage = dict(corpus_pipeline.STAGES)["repeated_passages"]
    left = {r.doc_id: r.text.split() for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    for i, text in rows:
        assert left[i] == [w for k, w in enumerate(text.split()) if k not in need.get(i, ())]
