"""Unit checks the oracle cannot make: catalog, guards, key resolution, templates, plans."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from weft import catalog
from weft.operators import compose, gates, sync, validate
from weft.plans.fixtures import REQUEST_SCHEMA
from weft.sinks.files import EmptyExport, scratch_dir, write_csv, write_json
from weft.sources.custom import jdbc_options
from weft.sources.files import read_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# B4 publish / unpublish a view over Parquet
def test_publish_and_unpublish(spark):
    df = read_table(spark, SF_SMALL, "region")
    catalog.register(df, "region_pub")
    assert catalog.load(spark, "region_pub").count() == df.count()
    assert catalog.unregister(spark, "region_pub")
    with pytest.raises(catalog.TableNotFound) as exc:
        catalog.load(spark, "region_pub")
    assert "available:" in str(exc.value)


# A9 / A10 catalog listings
def test_list_tables_and_databases(spark):
    catalog.register(read_table(spark, SF_SMALL, "nation"), "nation_listed")
    names = {r["name"] for r in catalog.list_tables(spark).collect()}
    assert "nation_listed" in names
    counted = catalog.list_tables(spark, {"nation_listed"}, with_counts=True).collect()
    assert counted[0]["n_rows"] == 25
    assert "default" in {r["name"] for r in catalog.list_databases(spark).collect()}


# C6 exporting an empty table is an error unless allowed
def test_empty_export_is_an_error(spark):
    empty = read_table(spark, SF_SMALL, "region").where(F.lit(False))
    with pytest.raises(EmptyExport):
        write_csv(empty, scratch_dir(spark, "t") + "/e.csv")
    with pytest.raises(EmptyExport):
        write_json(empty, scratch_dir(spark, "t") + "/e.json")
    assert write_csv(empty, scratch_dir(spark, "t") + "/ok.csv", allow_empty=True)


# E3 keys starting with "_" are dropped, but only outside directive nodes
def test_underscore_keys_stripped_outside_directives(spark):
    import json

    region = read_table(spark, SF_SMALL, "region").select(
        "r_regionkey", F.col("r_name").alias("_name"))
    doc = compose.compose(spark, {"_note": "x", "kept": 1, "rows": {
        "$table": "r", "$as": "array", "$order_by": "r_regionkey", "_ignored_here": True}}, {"r": region})
    out = json.loads(doc.first()["document"])
    assert set(out) == {"kept", "rows"}
    assert out["rows"][0] == {"r_regionkey": 0, "_name": "AFRICA"}


# F3 missing context: nothing to validate gives nothing back, not an error
def test_validate_empty_input(spark):
    empty = spark.createDataFrame([], "request_id long, doc string")
    checked = validate.validate(empty, REQUEST_SCHEMA, text="doc")
    assert "errors" in checked.columns and checked.count() == 0


def test_gate_broken_rule_policies(spark):
    metrics = spark.createDataFrame([(10, 0)], "total long, bad long")
    assert gates.gate_passes(metrics, "bad = 0")
    assert not gates.gate_passes(metrics, "bad > 0")
    with pytest.warns(UserWarning):
        assert gates.gate_passes(metrics, "no_such_col > 1", on_error="run")
    with pytest.warns(UserWarning):
        assert not gates.gate_passes(metrics, "no_such_col > 1", on_error="skip")
    with pytest.raises(ValueError):
        gates.gate_passes(metrics, "no_such_col > 1", on_error="raise")


# H2 key resolution: primary, single alternate, multi-column alternate in any order
def test_resolve_key():
    meta = {"primary": "accountid", "alternate_keys": [
        {"name": "acct_number", "columns": ["accountnumber"]},
        {"name": "name_city", "columns": ["name", "city"]}]}
    assert sync.resolve_key(meta) == ["accountid"]
    assert sync.resolve_key(meta, "AccountId") == ["accountid"]
    assert sync.resolve_key(meta, "accountnumber") == ["accountnumber"]
    assert sync.resolve_key(meta, "city, name") == ["name", "city"]
    with pytest.raises(ValueError) as exc:
        sync.resolve_key(meta, "email")
    assert "accountid" in str(exc.value)


def test_key_column_must_exist(spark):
    df = read_table(spark, SF_SMALL, "orders")
    assert sync.resolve_columns(df, ["O_ORDERKEY"]) == ["o_orderkey"]
    with pytest.raises(ValueError):
        sync.resolve_columns(df, ["missing"])


# A7 remote SQL reader options (no database is started here)
def test_jdbc_options():
    o = jdbc_options("jdbc:postgresql://h/db", table="t")
    assert o["dbtable"] == "t" and o["queryTimeout"] == "60"
    p = jdbc_options("jdbc:postgresql://h/db", query="select * from t", partition_column="id",
                     lower=0, upper=1000, num_partitions=8)
    assert p["dbtable"] == "(select * from t) q" and p["numPartitions"] == "8" and "query" not in p
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", query="q")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", partition_column="id")


# L7 join strategy: size-checked broadcast of a small side, sort-merge otherwise, hints honoured
def test_join_strategy_choice(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    nation = read_table(spark, SF_SMALL, "nation")
    customer = read_table(spark, SF_SMALL, "customer")
    small = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    assert "BroadcastHashJoin" in _plan(small)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = orders.join(customer, orders.o_custkey == customer.c_custkey)
        assert "SortMergeJoin" in _plan(big)
        hinted = orders.join(customer.hint("shuffle_hash"), orders.o_custkey == customer.c_custkey)
        assert "ShuffledHashJoin" in _plan(hinted)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_filters_and_columns_reach_the_scan(spark):
    import __spark_entry__ as entry

    df = entry.queries()["sql_filter_param"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan


def test_no_query_plans_a_cartesian_product(spark):
    import __spark_entry__ as entry

    skip = {n for n in entry.queries() if n.startswith("stream_")}  # streams run eagerly to files
    bad = []
    for name, fn in sorted(entry.queries().items()):
        if name in skip:
            continue
        plan = _plan(fn(spark, SF_SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert not bad, bad


# G9 chunked running size gives the same result as one window per step
def test_log_truncate_chunks_agree(spark):
    from weft.operators.runs import log_truncate

    logs = read_table(spark, SF_SMALL, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("role").alias("step"), F.col("turn").alias("seq"),
        F.col("text").alias("line"))
    one = log_truncate(logs, budget=700, chunk=10**9)
    many = log_truncate(logs, budget=700, chunk=2)
    assert one.count() > 0
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert one.where(F.col("line") == "[OUTPUT TRUNCATED DUE TO SIZE LIMIT]").count() > 0


# E1 a directive over more rows than allowed fails instead of cutting the document
def test_compose_row_guard_raises(spark):
    region = read_table(spark, SF_SMALL, "region")
    doc = compose.compose(spark, {"rows": {"$table": "r", "$as": "array"}}, {"r": region}, max_rows=3)
    with pytest.raises(Exception) as exc:
        doc.collect()
    assert "more than 3 rows" in str(exc.value)
    ok = compose.compose(spark, {"rows": {"$table": "r", "$as": "array"}}, {"r": region}, max_rows=5)
    assert ok.first()["document"].count("r_regionkey") == 5


# T4 merge on read: batches append, compaction every K batches, replay is idempotent
def test_versioned_merge_compacts_and_replays(spark):
    import os

    from weft.streaming import streams

    root = scratch_dir(spark, "t") + "/target"
    streams.seed_versioned(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), root)
    batches = [[(1, "a1", 1)], [(3, "c", 1), (3, "c2", 2)], [(2, "b1", 5)], [(1, "a2", 1)]]
    for i, rows in enumerate(batches):
        b = spark.createDataFrame(rows, "k long, v string, at int")
        streams._versioned_merge(b, ["k"], root, i, order="at", compact_every=2)
    streams._versioned_merge(spark.createDataFrame(batches[3], "k long, v string, at int"), ["k"], root, 3,
                             order="at", compact_every=2)  # replay of batch 3
    got = {r["k"]: r["v"] for r in streams.read_versioned(spark, root, ["k"]).collect()}
    assert got == {1: "a2", 2: "b1", 3: "c2"}
    bases = sorted(n for n in os.listdir(root) if n.startswith("base-"))
    assert bases == ["base-000000000000", "base-000000000002", "base-000000000004"]


# A14 connector: per-row-group and per-file planning read the same rows
def test_rowgroup_source_planning_modes(spark):
    from weft.sources.custom import read_rowgroups

    path = scratch_dir(spark, "t") + "/orders"
    read_table(spark, SF_SMALL, "orders").repartition(3).write.parquet(path)
    by_group = read_rowgroups(spark, path)
    by_file = read_rowgroups(spark, path, footer_planning_max_files=0)
    assert by_file.rdd.getNumPartitions() == 3
    assert by_group.count() == by_file.count() == 1500
    assert by_group.exceptAll(by_file).count() == 0


# Q15 a step's row count comes from the write, not from re-reading it
def test_save_step_counts_rows_on_the_write(spark):
    orders = read_table(spark, SF_SMALL, "orders").where(F.col("o_orderstatus") == "F")
    saved, n = catalog.save_step(orders, "orders_f", scratch_dir(spark, "t"))
    assert n == orders.count() == saved.count() and n > 0


# Q11/Q12 every statement with a result is published, named by its position
def test_run_statements_names_by_position(spark):
    catalog.register(read_table(spark, SF_SMALL, "orders"), "orders")
    out = catalog.run_statements(spark, "step", [
        "select count(*) as n from orders",
        "create or replace temp view big as select * from orders where o_totalprice > 100000",
        "with x as (select o_orderstatus from big) select distinct o_orderstatus from x",
    ])
    assert set(out) == {"step", "step_3"}
    assert spark.table("step").first()["n"] == 1500
    assert spark.table("step_3").count() == out["step_3"].count() > 0


# spreading a small scan adds a round-robin exchange and runs nothing eagerly
def test_spread_rows_on_a_scan_is_lazy(spark):
    from weft.session import spread_rows

    sc = spark.sparkContext
    events = read_table(spark, SF_SMALL, "events")  # a first read infers the schema (one job)
    sc.setJobGroup("spread-probe", "spread-probe")
    try:
        spread = spread_rows(events, min_partitions=4)
        assert sc.statusTracker().getJobIdsForGroup("spread-probe") == []
    finally:
        sc.setJobGroup(None, None)
    assert spread.rdd.getNumPartitions() == 4
    assert spread.count() == read_table(spark, SF_SMALL, "events").count()


# partitioned export: a filter on the partition column prunes directories at the scan
def test_partitioned_export_prunes(spark):
    from weft.sinks.files import write_parquet

    path = write_parquet(read_table(spark, SF_SMALL, "orders"), scratch_dir(spark, "t") + "/orders_by_priority",
                         partition_by=["o_orderpriority"])
    urgent = spark.read.parquet(path).where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    plan = _plan(urgent)
    assert "PartitionFilters: [" in plan and "1-URGENT" in plan.split("PartitionFilters: [")[1].split("]")[0]
    expected = read_table(spark, SF_SMALL, "orders").where(F.col("o_orderpriority") == "1-URGENT").count()
    assert urgent.count() == expected > 0


# the README pipeline end to end: validate, gate, shred + save, upsert a child table, plan batches
def test_readme_pipeline(spark):
    import weft
    from weft.plans.fixtures import request_documents

    raw = request_documents(spark, SF_SMALL).select("request_id", "doc")
    checked = weft.validate(raw, REQUEST_SCHEMA, text="doc")
    metrics = weft.quality_metrics(checked, bad=F.size("errors") > 0)
    good = weft.gated(weft.valid_rows(checked), metrics, "bad <= total")
    doc_schema = "query struct<name: string>, body struct<age: int>, tags array<string>"
    docs = good.select("request_id", F.from_json("doc", doc_schema).alias("d")).select("request_id", "d.*")
    tables = weft.save_auto(docs, "req", root=scratch_dir(spark, "t"), key_cols=["request_id"])
    assert {"req", "req_query", "req_body", "req_tags"} <= set(tables)
    tags = tables["req_tags"].drop("_children")
    target = weft.upsert(tags.where(F.col("_pos") > 0), tags, keys=["_row_id"])
    assert target.count() == tags.count() > 0
    plan = weft.batch_plan(target, order="_row_id", batch_size=10)
    assert plan.agg(F.max("_idx")).first()[0] == tags.count() - 1


# L6 the time bucket only splits the work: any bucket size gives the same matches
def test_asof_bucket_size_does_not_change_matches(spark):
    from weft.operators.asof import join_asof

    ev = read_table(spark, SF_SMALL, "events")
    p = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    v = ev.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    small = join_asof(p, v, "user_id", "ts", right_ts="view_ts", bucket_seconds=60)
    one = join_asof(p, v, "user_id", "ts", right_ts="view_ts", bucket_seconds=10**9)
    assert small.count() == one.count() == p.count()
    assert small.exceptAll(one).count() == 0
    assert small.where(F.col("view_id").isNotNull()).count() > 0


# E4 per-key documents can refuse a key with too many items before collecting
def test_compose_per_key_item_guard(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    most = orders.groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    with pytest.raises(ValueError, match="max_items"):
        compose.compose_per_key(orders, "o_custkey", ["o_orderkey"], "o_orderkey", max_items=most - 1)
    docs = compose.compose_per_key(orders, "o_custkey", ["o_orderkey"], "o_orderkey", max_items=most)
    assert docs.agg(F.sum("n_items")).first()[0] == orders.count()


# F1 staged validation (segments + lambda checks above the generator) keeps schema order
def test_staged_validation_matches_inline_order(spark):
    schema = {"type": "object", "additionalProperties": False, "required": ["a", "tags"],
              "properties": {"a": {"type": "string", "minLength": 2},
                             "tags": {"type": "array", "minItems": 1, "items": {"type": "integer", "maximum": 5}},
                             "b": {"type": "integer", "minimum": 0}}}
    docs = ['{"a": "x", "tags": [1, 7, "q"], "b": -1, "zz": 1}', '{"a": "ok", "tags": [], "b": 3}',
            '{"tags": [2], "b": "n"}', '{"a": 5}', 'not json', '{"a": "fine", "tags": [1, 2], "b": 0}']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    staged = {r["id"]: r["errors"] for r in validate.validate(df, schema, text="doc").collect()}
    check = validate.compile_schema(schema)
    inline = {r["id"]: r["e"] for r in df.select("id", check(F.try_parse_json("doc")).alias("e")).collect()}
    for i in range(len(docs)):
        expected = inline[i] if docs[i] != "not json" else ["data must be valid JSON"]
        assert staged[i] == expected, (i, staged[i], expected)
    assert staged[0][0] == "data must NOT have additional properties"
    assert staged[5] == []
