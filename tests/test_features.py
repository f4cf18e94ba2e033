"""Ledger, saved tables, intervals, step conditions, samples, connector and stateful streams: cases beyond the queries."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.functions.scalar import safe_int_json
from weft.operators import intervals, ledger, runs, sessions, sketches, sync
from weft.plans.registry import QUERIES, load_all
from weft.sources import arrow_files
from weft.sources.files import TABLE_NAMES, stream_parquet
from weft.streaming import run_state, streams
from weft.tables import SavedTable

load_all()


# ---- merges and the ledger

def test_a_repeated_source_key_fails_or_the_newest_wins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 3), (3, "z", 2)], "k int, v string, at int")
    for call in (sync.upsert, sync.update, lambda t, s, k, **o: sync.insert(t, s, k, **o)[0]):
        with pytest.raises(Exception, match="more than once"):
            call(target, twice.drop("at"), ["k"]).collect()
    got = sync.upsert(target, twice, ["k"], order="at").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "y"), (3, "z")]
    got = sync.update(target, twice, ["k"], order="at").select("k", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "y")]


def test_the_check_for_repeated_keys_holds_no_table_of_keys(spark):
    target, source = (spark.range(n).selectExpr("id as k", "'x' as v") for n in (100, 50))
    merged = sync.upsert(target, source, ["k"])
    assert "HashAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    assert merged.count() == 100


def test_ledger_outcomes_and_reruns(spark, tmp_path):
    target = SavedTable(spark, str(tmp_path / "t"))
    target.create(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    book = ledger.open_ledger(spark, str(tmp_path / "l"))
    rows = [(1, "a"), (2, "c"), (4, "d"), (4, "e"), (None, "n"), (5, "f")]
    source = spark.createDataFrame(rows, "k int, v string")
    said = {(r.record_key, r.message) for r in ledger.sync(source, target, book, ["k"], "insert", batch_size=2).collect()}
    assert said == {("1:1", None), ("1:2", "key exists in the target"), ("1:4", "key occurs 2 times in the source"),
                    ("~", "key is null"), ("1:5", None)}
    assert sorted(map(tuple, target.read().collect())) == [(1, "a"), (2, "b"), (5, "f")]
    again = ledger.sync(source, target, book, ["k"], "upsert")
    assert {r.record_key for r in again.collect()} == {"1:2", "1:4", "~"}
    fixed = source.where("k is not null and v <> 'd'")
    assert {(r.record_key, r.ok) for r in ledger.sync(fixed, target, book, ["k"], "upsert").collect()} == {("1:4", True)}
    assert ledger.sync(fixed, target, book, ["k"], "upsert").collect() == []
    assert ledger.sync(fixed, target, book, ["k"], "delete").where("ok").count() == 4
    assert target.read().collect() == []
    assert book.read().agg(F.max("run")).first()[0] == 4


def test_ledger_order_lets_the_newest_through(spark, tmp_path):
    target = SavedTable(spark, str(tmp_path / "t"))
    target.create(spark.createDataFrame([], "k int, v string, at int"))
    book = ledger.open_ledger(spark, str(tmp_path / "l"))
    source = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, at int")
    got = ledger.sync(source, target, book, ["k"], order="at").collect()
    assert sorted((r.ok, r.message) for r in got if r.ok) == [(True, None)] and len(got) == 2
    assert [r.v for r in target.read().collect()] == ["new"]


def test_a_run_that_died_before_the_ledger_is_sent_again(spark, tmp_path):
    target = SavedTable(spark, str(tmp_path / "t"))
    target.create(spark.createDataFrame([], "k int, v string"))
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    ledger.sync(source, target, ledger.open_ledger(spark, str(tmp_path / "lost")), ["k"], "insert")
    got = ledger.sync(source, target, ledger.open_ledger(spark, str(tmp_path / "l")), ["k"], "insert").collect()
    assert [r.ok for r in got] == [True, True] and target.read().count() == 2


def test_saved_table_versions(spark, tmp_path):
    table = SavedTable(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([(1, "a")], "id int, v string"))
    table.add_column("n", "bigint", 7)
    table.insert(spark.createDataFrame([(2, 5)], "id int, n int"))
    assert table.versions() == [0, 1, 2]
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 7), (2, None, 5)]
    assert table.read(0).columns == ["id", "v"] and table.read(1).first().n == 7
    with pytest.raises(ValueError, match="does not have"):
        table.insert(spark.createDataFrame([(3, 1)], "id int, other int"))
    with pytest.raises(ValueError, match="exists"):
        table.add_column("N", "int")
    with pytest.raises(Exception, match="exist"):  # a second writer from the same version
        table._commit({**table.manifest(1), "version": 2})
    table.overwrite(table.read().where("id = 2"))
    assert table.read().count() == 1 and table.read(2).count() == 2


# ---- joins, steps, samples

def _overlaps(a, b):
    return sorted((x[0], y[0]) for x in a for y in b
                  if None not in x and None not in y and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])


@pytest.mark.parametrize("bin_rows", [1 << 16, 7])
def test_interval_join(spark, bin_rows):
    rng = random.Random(bin_rows)

    def side(n):
        rows = [(k, s := rng.randrange(-50, 400), s + rng.choice([0, 1, 3, 10, 200])) for k in range(n)]
        return [*rows, (n, 5, 1), (n + 1, None, 9), (n + 2, 3, None), *[(1000 + k, 100, 101) for k in range(n // 2)]]

    a, b = side(60), side(40)
    left = spark.createDataFrame(a, "l int, s int, e int").repartition(3)
    right = spark.createDataFrame(b, "r int, x int, y int").repartition(4)
    joined = intervals.join_intervals(left, right, ("s", "e"), ("x", "y"), bin_rows=bin_rows)
    assert sorted((r.l, r.r) for r in joined.collect()) == _overlaps(a, b)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.join_intervals(left.where("false"), right, ("s", "e"), ("x", "y")).collect() == []


def test_step_outcomes_against_a_walk(spark):
    rng = random.Random(2)
    steps, needs = [], []
    for run in range(12):
        for step in range(9):
            steps.append((run, step, rng.choice(["success", "success", "error"])))
            for on in rng.sample(range(step), min(step, rng.randrange(0, 4))):
                needs.append((run, step, on, rng.choice([None, ["success"], ["error", "skipped"], ["success", "skipped"]])))
    steps += [(99, 0, "success"), (99, 1, "success"), (99, 2, "success"), (None, 0, "error")]
    needs += [(99, 0, 1, None), (99, 1, 0, None), (99, 2, 77, None)]  # a cycle and a missing step
    final = {}
    for run, step, outcome in steps:
        mine = [n for n in needs if n[:2] == (run, step)]
        met = all(w is None or final.get((run, on)) in w for _, _, on, w in mine)
        final[run, step] = "pending" if run == 99 else outcome if met else "skipped"
    got = runs.step_outcomes(spark.createDataFrame(steps, "run_id int, step int, outcome string"),
                             spark.createDataFrame(needs, "run_id int, step int, on int, wanted array<string>"))
    assert {(r.run_id, r.step): r.final_outcome for r in got.collect()} == final


def test_sample_does_not_depend_on_the_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("s"), F.lit(None).cast("int").alias("z"))
    want = sorted(map(tuple, sketches.sample_stratified(df, ["s", "z"], "id", 7, "x").collect()))
    for parts in (1, 5):
        assert sorted(map(tuple, sketches.sample_stratified(df.repartition(parts), ["s", "z"], "id", 7, "x").collect())) == want
    assert len(want) == 21 and abs(sum(r[3] for r in want) - 500) < 1e-9
    assert sorted(map(tuple, sketches.sample_stratified(df, ["s", "z"], "id", 7, "y").collect())) != want


def test_sketches_of_any_days_add_up(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("day"), F.expr("id * 13 % 9973").cast("double").alias("v"))
    states = sketches.sketch_states(df, ["day"], "id", "v")
    row = sketches.merge_states(states.where("day < 5"), []).select(
        "n", sketches.distinct_estimate().alias("d"), sketches.quantile_estimate(0.5).alias("q")).first()
    part = df.where("day < 5")
    assert row.n == part.count() and abs(row.d - row.n) < sketches.DISTINCT_ERROR * row.n
    assert abs(part.where(F.col("v") <= row.q).count() / row.n - 0.5) < sketches.RANK_ERROR


def test_sessions_keep_null_keys_and_skip_null_times(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at), ("a", at + dt.timedelta(seconds=5)), ("a", at + dt.timedelta(seconds=30)), (None, at), ("a", None)]
    spark.createDataFrame(rows, "k string, t timestamp_ntz").createOrReplaceTempView("_s")
    got = spark.sql(f"select * from {sessions.register(spark)}(table(_s), 'k', 't', 10)").collect()
    assert sorted((r.k or "", r.n) for r in got) == [("", 1), ("a", 1), ("a", 2)]


# ---- connector

def test_connector_commits_and_filters(spark, tmp_path):
    name, path = arrow_files.register_arrow(spark), str(tmp_path / "a")
    df = spark.range(1000).select("id", F.concat(F.lit("v"), "id").alias("v"))
    df.repartitionByRange(4, "id").write.format(name).mode("append").save(path)

    @F.udf("long")
    def broken(x):
        if x == 999:
            raise ValueError("task fails")
        return x

    with pytest.raises(Exception, match="task fails"):
        df.select(broken("id").alias("id"), "v").write.format(name).mode("append").save(path)
    read = spark.read.format(name).schema("id bigint, v string").load(path)
    assert read.count() == 1000 and read.where("id >= 990 and v < 'v995'").count() == 5
    assert len(list((tmp_path / "a").glob("*.arrow"))) == 4
    reader = arrow_files.Reader(path, read.schema)
    reader.filters = [("id", arrow_files.GreaterThan, 900)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 500
    stream = arrow_files.StreamReader(path, read.schema)
    df.where("id < 3").coalesce(1).write.format(name).mode("append").save(path)
    assert [len(stream.partitions({"commits": a}, {"commits": b})) for a, b in ((0, 1), (1, 2), (0, 2))] == [4, 1, 5]
    with pytest.raises(Exception, match="append-only"):
        df.write.format(name).mode("overwrite").save(path)


# ---- streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _event_files(spark, folder, groups):
    for rows in groups:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_add_up_for_any_file_order(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=17 * k), 1, "ab"[k % 2], float(k)) for k in range(12)]
    results, late = set(), []
    for n, order in enumerate(itertools.permutations([rows[:4], rows[4:8], rows[8:]])):
        if n not in (0, 3, 5):
            continue
        folder, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        _event_files(spark, folder, order)
        stream = streams.file_stream(spark, folder, EVENTS, max_files=1)
        streams.stream_windows(stream, "ts", ["event_type"], "1 hour", "20 minutes", out, str(tmp_path / f"c{n}"), total="value")
        done = streams.corrected_windows(spark, out, EVENTS, "ts", ["event_type"], "1 hour", total="value").collect()
        assert sum(r.n_on_time + r.n_late for r in done) == len(rows)
        late.append(sum(r.n_late for r in done))
        results.add(tuple(sorted((str(r.window.start), r.event_type, r.n_on_time + r.n_late, r.total) for r in done)))
    assert len(results) == 1 and late[0] == 0 and late[-1] > 0


def test_older_change_in_a_later_batch_does_not_win(spark, tmp_path):
    root, folder = str(tmp_path / "t"), str(tmp_path / "in")
    streams.seed_versioned(spark.createDataFrame([(1, "seed", 5), (2, "seed", 5)], "k int, v string, at int"), root, order="at")
    for rows in ([(1, "new", 20)], [(1, "old", 10), (2, "older than the seed", 1)], [(3, "x", 1)]):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("append").parquet(folder)
    changes = streams.file_stream(spark, folder, "k int, v string, at int", max_files=1)
    streams.stream_upsert(changes, ["k"], "at", root, str(tmp_path / "c"))
    assert sorted((r.k, r.v) for r in streams.read_versioned(spark, root, ["k"]).collect()) == [
        (1, "new"), (2, "seed"), (3, "x")]


def test_runs_merge_over_batches_in_any_order(spark, tmp_path):
    start, minute = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)

    def row(k, m, user=1, status="view"):
        return (k, start + m * minute, user, status, 0.0)

    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "c"))
    # 0 and 40 are two runs until 20 arrives, which joins them; user 2 closes late, user 3 stays open.
    _event_files(spark, folder, [[row(1, 0), row(2, 40, status="error")], [row(3, 20, status="click"), row(4, 45, user=2)]])
    for k in range(2):
        events = streams.with_event_time(streams.file_stream(spark, folder, EVENTS, max_files=1))
        run_state.close_runs(events, "user_id", "ts", "event_id", "event_type", out, ckpt, "30 minutes", "1 hour")
        if k == 0:
            assert spark.read.parquet(out).count() == 0
            _event_files(spark, folder, [[row(5, 300, user=3), (None, None, 9, "x", 0.0)]])
    got = {(r.user_id, r.n_events, r.last_status, r.state) for r in run_state.read_runs(spark, out, ckpt, "user_id").collect()}
    assert got == {(1, 3, "error", "closed"), (2, 1, "view", "closed"), (3, 1, "view", "open")}


def test_streams_read_files_and_folders(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    lone = next((tmp_path / "folder.parquet").glob("part-*.parquet"))
    for path, least in ((tmp_path / "folder.parquet", 10), (lone, 1)):
        out = str(tmp_path / f"out{least}")
        streams.run_to_parquet(stream_parquet(spark, str(path)), out, out + "-c")
        assert spark.read.parquet(out).count() == spark.read.parquet(str(path)).count() >= least


# ---- results past the limits of a type or a setting

def _orders_copy(spark, folder, keys):
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_safe_integers_past_64_bits(spark, tmp_path):
    keys = [0, 900, 901, 922337, 922338, 9_000_000, -922338, None]
    got = QUERIES["safe_int_json"](spark, _orders_copy(spark, tmp_path, keys)).collect()
    assert {r.o_orderkey: r.json for r in got} == {
        k: "null" if k is None else str(k * 10**13) if abs(k * 10**13) < 2**53 else f'"{k * 10**13}"' for k in keys}
    least = spark.sql("select -9223372036854775808 as v").select(safe_int_json("v")).first()[0]
    assert least == '"-9223372036854775808"'


def test_recursion_over_more_than_a_million_rows(spark, tmp_path):
    folder, n = tmp_path / "lines", 1_050_000
    lines = spark.range(n).selectExpr("id as l_orderkey", "1 as l_linenumber").unionByName(
        spark.range(3).selectExpr("id as l_orderkey", "2 as l_linenumber"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    for name in TABLE_NAMES:
        if name != "lineitem":
            spark.range(1).write.parquet(f"{folder}/{name}.parquet")
    got = QUERIES["sql_recursive"](spark, str(folder)).groupBy("chain_len").count().collect()
    assert sorted(map(tuple, got)) == [(1, n - 3), (2, 3)]


def test_runs_of_many_keys_share_few_state_calls(spark, tmp_path, monkeypatch):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=rng.randrange(8 * 3600)), rng.randrange(400), rng.choice("abc"), 0.0)
            for k in range(3000)]
    rows.sort(key=lambda r: r[1])
    monkeypatch.setattr(run_state, "BUCKETS", 8)
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "c"))
    calls = spark.sparkContext.accumulator(0)
    inner = run_state.RunProcessor.handleInputRows

    def counted(self, key, chunk, timers):
        calls.add(1)
        return inner(self, key, chunk, timers)

    monkeypatch.setattr(run_state.RunProcessor, "handleInputRows", counted)
    _event_files(spark, folder, [rows[:1500], rows[1500:]])
    events = streams.with_event_time(streams.file_stream(spark, folder, EVENTS, max_files=1))
    run_state.close_runs(events, "user_id", "ts", "event_id", "event_type", out, ckpt, "30 minutes", "1 minute")
    want, last = [], rows[-1][1]
    for user in {r[2] for r in rows}:
        run = []
        for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])) + [None]:
            if run and (r is None or r[1] - run[-1][1] >= dt.timedelta(minutes=30)):
                over = run[-1][1] + dt.timedelta(minutes=31) <= last
                want.append((user, run[0][1], run[-1][1], len(run), run[-1][0], run[-1][3], "closed" if over else "open"))
                run = []
            run.append(r)
    got = [tuple(r) for r in run_state.read_runs(spark, out, ckpt, "user_id").collect()]
    assert sorted(got) == sorted(want)
    assert calls.value <= 16  # a call per bucket and batch, not per key
