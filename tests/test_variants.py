"""Node tables of irregular documents, collision-free ids and bucketed rebuilds."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators.nested import rebuild, rebuild_local, save_bucketed, shred
from weft.operators.sync import fill_keys
from weft.operators.variants import rebuild_variant, shred_variant

SCALARS = st.none() | st.booleans() | st.integers(-10**12, 10**12) | st.text(max_size=6)
VALUES = st.recursive(SCALARS, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4),
                      max_leaves=8)


def _shredded(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return docs, shred_variant(docs.select("id", F.expr("try_parse_json(text)").alias("v")), "id", **options)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, min_size=15, max_size=25))
def test_any_documents_come_back(spark, values):
    texts = [json.dumps(v) for v in values] + [None, "not json {"]
    docs, nodes = _shredded(spark, texts)
    back = {r.id: r.text for r in rebuild_variant(nodes, "id").collect()}
    want = {r.id: r.t for r in docs.select("id", F.expr("to_json(try_parse_json(text))").alias("t")).collect()}
    assert back == want
    assert nodes.groupBy("id", "path").count().where("count > 1").isEmpty()


def test_keys_that_look_like_paths(spark):
    _, nodes = _shredded(spark, ['{"a.b":1,"a":{"b":2},"a\\"][\\"b":3,"0":[4],"":{"":5}}'])
    back = rebuild_variant(nodes, "id").first().text
    assert json.loads(back) == {"a.b": 1, "a": {"b": 2}, 'a"]["b': 3, "0": [4], "": {"": 5}}


def test_depth_limit_keeps_deeper_parts_as_text(spark):
    _, nodes = _shredded(spark, ['{"a":{"b":{"c":[1]}},"d":[]}'], depth_limit=2)
    assert {(r.path, r.kind, r.value) for r in nodes.collect()} == {
        ("$", "object", None), ('$["a"]', "json", '{"b":{"c":[1]}}'), ('$["d"]', "json", "[]")}
    assert rebuild_variant(nodes, "id").first().text == '{"a":{"b":{"c":[1]}},"d":[]}'


def test_rebuilding_moves_every_row_once(spark):
    _, nodes = _shredded(spark, ['{"a":[1,{"b":2}]}'] * 5)
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    plan = rebuild_variant(nodes, "id")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == nodes.agg(F.max("depth")).first()[0] + 1  # each level's own rows, by document
    assert all("REPARTITION" in line for line in exchanges)


def test_repeated_document_ids_raise(spark):
    docs = spark.createDataFrame([(1, '{"a":1}'), (1, '{"a":2}')], "id int, text string")
    nodes = shred_variant(docs.select("id", F.expr("parse_json(text)").alias("v")), "id")
    with pytest.raises(Exception, match="several"):
        rebuild_variant(nodes, "id").collect()


def test_empty_variant_table(spark):
    docs = spark.createDataFrame([], "id int, text string")
    nodes = shred_variant(docs.select("id", F.expr("parse_json(text)").alias("v")), "id")
    assert nodes.collect() == [] and rebuild_variant(nodes, "id").collect() == []


KEYS = [("x|y", "z", [1]), ("x", "y|z", [2, 2]), ("n", None, [3]), (None, "n", [4]), (None, None, []), ("", None, None),
        ("1:x", "~", [5]), ("~", "1:x", [6])]


def test_composite_keys_with_separators_and_nulls_do_not_meet(spark):
    docs = spark.createDataFrame(KEYS, "a string, b string, items array<int>").repartition(3)
    back = rebuild(shred(docs, "t", key_cols=["a", "b"]))
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    filled = fill_keys(docs.withColumn("k", F.lit(None).cast("string")), "k", ["a", "b"])
    assert filled.select("k").distinct().count() == len(KEYS)


def test_bucketed_rebuild_needs_no_exchange(spark, tmp_path):
    docs = spark.range(40).select(
        "id", F.expr("transform(sequence(1, int(id % 4) + 1), i -> struct(i as n, "
                     "if(i = 2, null, transform(sequence(1, i), j -> struct(j as m, map('k', j) as tags))) as inner))").alias("items"),
        F.expr("if(id = 3, null, struct(id as x, array(id, null) as y))").alias("one"), F.expr("array()").cast("array<int>").alias("none"))
    parts = save_bucketed(shred(docs, "t", key_cols=["id"], root_ids=True), str(tmp_path / "tables"), buckets=4)
    back = rebuild_local(parts)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    key = lambda df: sorted(map(str, df.select("id", F.to_json(F.struct(*docs.columns)).alias("j")).collect()))
    assert key(back) == key(docs)
