"""The reference's rule and run cases re-expressed on tables, and property tests
for write-back and validation (SURVEY §5: F5/F6/G1/G2, H4/H9, F2)."""

import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from weft.operators import gates, runs, sync, validate
from weft.plans.fixtures import REQUEST_SCHEMA, request_documents
from weft.sources.files import read_table

CTX = ("cell_1 struct<status: string, rowCount: bigint, output: struct<total: bigint, flag: boolean>>, "
       "cell_2 struct<status: string, rowCount: bigint>, grp struct<load: string>, env struct<mode: string>")


@pytest.fixture(scope="module")
def ctx(spark):
    return spark.createDataFrame(
        [(("success", 12, (150, True)), ("error", None), ("success",), ("prod",))], CTX)


def _rule(ctx, text, on_error="run"):
    return ctx.transform(lambda d: gates.evaluate_rules(d, {"r": text}, on_error=on_error)).first()["r"]


# ---- condition cases

def test_empty_condition_is_true(ctx):
    assert _rule(ctx, "") is True
    assert _rule(ctx, None) is True


def test_step_status(ctx):
    assert _rule(ctx, "cell_1.status == 'success'") is True
    assert _rule(ctx, "cell_2.status == 'success'") is False


def test_row_count(ctx):
    assert _rule(ctx, "cell_1.rowCount > 10") is True
    assert _rule(ctx, "cell_1.rowCount > 20") is False


def test_group_status(ctx):
    assert _rule(ctx, "grp.load == 'success'") is True


def test_nested_output(ctx):
    assert _rule(ctx, "cell_1.output.total >= 100 and cell_1.output.flag") is True


def test_env_with_and_or(ctx):
    assert _rule(ctx, "env.mode == 'prod' and cell_1.rowCount > 5") is True
    assert _rule(ctx, "env.mode == 'dev' or cell_2.status == 'error'") is True
    assert _rule(ctx, "env.mode == 'dev' and cell_2.status == 'error'") is False


def test_null_comparison_is_false(ctx):
    assert _rule(ctx, "cell_2.rowCount > 0") is False


def test_broken_condition_fails_open_with_warning(ctx):
    with pytest.warns(UserWarning):
        assert _rule(ctx, "cell_9.status == 'success'") is True
    with pytest.warns(UserWarning):
        assert _rule(ctx, "cell_1.status ==", on_error="skip") is False
    with pytest.raises(ValueError):
        _rule(ctx, "cell_9.status == 'success'", on_error="raise")


def test_unknown_step_name_in_valid_syntax_runs(ctx):
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert _rule(ctx, "no_such.rowCount > 1") is True
    assert caught


# ---- run cases

STEPS = "run_id long, group_name string, ts long, event_id long, cond boolean, outcome string, is_output boolean"


def _final(spark, rows):
    df = spark.createDataFrame(rows, STEPS)
    out = runs.abort_propagation(df).select("event_id", "final_status").collect()
    return {r["event_id"]: r["final_status"] for r in out}


def test_error_aborts_rest_of_group(spark):
    got = _final(spark, [(1, "g", 1, 1, None, "success", False), (1, "g", 2, 2, None, "error", False),
                         (1, "g", 3, 3, None, "success", False), (1, "h", 4, 4, None, "success", False)])
    assert got == {1: "success", 2: "error", 3: "skipped", 4: "success"}


def test_false_condition_aborts_group_but_own_true_condition_runs(spark):
    got = _final(spark, [(1, "g", 1, 1, False, "success", False), (1, "g", 2, 2, None, "success", False),
                         (1, "g", 3, 3, True, "success", False)])
    assert got == {1: "skipped", 2: "skipped", 3: "success"}


def test_group_status_rules(spark):
    rows = [(1, "err", "success"), (1, "err", "error"), (1, "pend", None), (1, "pend", "success"),
            (1, "part", "skipped"), (1, "part", "success"), (1, "skip", "skipped"), (1, "skip", "skipped"),
            (1, "ok", "success")]
    df = spark.createDataFrame(rows, "run_id long, group_name string, status string")
    got = {r["group_name"]: r["group_status"] for r in runs.group_status(df).collect()}
    assert got == {"err": "error", "pend": "pending", "part": "partial", "skip": "skipped", "ok": "success"}


def test_rollback_branch_when_gate_fails(spark):
    main = spark.createDataFrame([(1, "main")], "id long, branch string")
    rollback = spark.createDataFrame([(0, "rollback")], "id long, branch string")
    metrics = spark.createDataFrame([(10, 3)], "total long, bad long")
    taken = gates.gated_with_fallback(main, rollback, metrics, "bad = 0").collect()
    assert [r["branch"] for r in taken] == ["rollback"]
    taken = gates.gated_with_fallback(main, rollback, metrics, "bad < 5").collect()
    assert [r["branch"] for r in taken] == ["main"]


def test_stop_at_output_step(spark):
    df = spark.createDataFrame([(1, "g", 1, 1, None, "success", False), (1, "g", 2, 2, None, "success", True),
                                (1, "g", 3, 3, None, "success", False), (2, "g", 1, 4, None, "success", False)],
                               STEPS)
    kept = sorted(r["event_id"] for r in runs.stop_after_output(df).collect())
    assert kept == [1, 2, 4]


# ---- properties (H4, H9, F2)

keys = st.lists(st.integers(0, 30), max_size=25)


@settings(max_examples=10, deadline=None)
@given(keys, keys)
def test_upsert_is_idempotent_and_keyed(spark, target_keys, source_keys):
    t = spark.createDataFrame([(k, "t") for k in sorted(set(target_keys))], "k long, v string")
    s = spark.createDataFrame([(k, "s") for k in sorted(set(source_keys))], "k long, v string")
    once = sync.upsert(t, s, ["k"])
    twice = sync.upsert(once, s, ["k"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    expect = {k: "t" for k in target_keys} | {k: "s" for k in source_keys}
    assert dict(a) == expect


@pytest.mark.parametrize("batch_size", [1, 7, 1000])
def test_batch_plan_sizes_and_contiguous_index(spark, batch_size):
    o = read_table(spark, SF_SMALL, "orders").select("o_orderkey").repartition(5)
    plan = sync.batch_plan(o, "o_orderkey", batch_size, num_partitions=4)
    rows = plan.select("o_orderkey", "_idx", "_batch", "_batch_pos").collect()
    idx = sorted(r["_idx"] for r in rows)
    assert idx == list(range(len(rows)))
    by_key = sorted(rows, key=lambda r: r["o_orderkey"])
    assert [r["_idx"] for r in by_key] == idx  # index follows the order
    sizes = plan.groupBy("_batch").count().collect()
    assert max(r["count"] for r in sizes) <= batch_size
    assert all(r["_batch"] * batch_size + r["_batch_pos"] == r["_idx"] for r in rows)


def test_valid_and_rejected_partition_the_input(spark):
    checked = validate.validate(request_documents(spark, SF_SMALL), REQUEST_SCHEMA, text="doc")
    n = checked.count()
    v, r = validate.valid_rows(checked), validate.rejected_rows(checked)
    assert v.count() + r.count() == n
    assert v.join(r, "request_id").count() == 0
    assert v.where(F.size("errors") > 0).count() == 0
