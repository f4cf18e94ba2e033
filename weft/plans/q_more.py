"""Interval joins, step conditions, mergeable sketches, fixed samples and table-argument functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import catalog
from weft.operators import intervals, runs, sessions, sketches
from weft.plans.registry import query
from weft.sinks.files import scratch_dir
from weft.sources.arrow_files import register_arrow
from weft.sources.files import read_table
from weft.streaming import streams


@query("sql_join_interval", """
select a.event_id as purchase_id, b.event_id as error_id
from events a join events b
  on a.event_type = 'purchase' and b.event_type = 'error'
 and a.ts <= b.ts + interval 10 minute and b.ts <= a.ts + to_microseconds((a.value * 60000000)::bigint)
""")
def q_join_interval(spark, sf_dir):
    """Purchases (open for as many minutes as their value) and the errors (of ten minutes) they overlap."""
    ev = read_table(spark, sf_dir, "events")
    stay = F.expr("ts + make_dt_interval(0, 0, 0, cast(round(value * 60, 6) as decimal(18, 6)))")
    a = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("ts").alias("a"), stay.alias("z"))
    b = ev.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("b"),
                                                F.expr("ts + interval 10 minutes").alias("y"))
    return intervals.join_intervals(a, b, ("a", "z"), ("b", "y")).select("purchase_id", "error_id")


_STEPS = """
select user_id * 1000000 + (row_number() over w - 1) // 8 as run_id, (row_number() over w - 1) % 8 as step,
       case when event_type = 'error' then 'error' else 'success' end as outcome, <k> % 4 as rule
from events window w as (partition by user_id order by ts, event_id)
"""


@query("step_outcomes", f"""
with recursive s as ({_STEPS.replace('<k>', "(props::json->>'k')::int")}),
     r as (select run_id, step, outcome as final_outcome from s where step = 0
           union all
           select s.run_id, s.step, case when s.rule = 0 or (s.rule in (1, 3) and r.final_outcome = 'success')
                                          or (s.rule = 2 and r.final_outcome in ('error', 'skipped'))
                                         then s.outcome else 'skipped' end
           from r join s on s.run_id = r.run_id and s.step = r.step + 1)
select run_id, step, final_outcome from r
""")
def q_step_outcomes(spark, sf_dir):
    """Chains of eight steps per run; each runs after any outcome, after success, or after an error or skip of the one before."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("_step_events")
    text = _STEPS.replace("<k>", "cast(get_json_object(props, '$.k') as int)").replace("from events", "from _step_events")
    steps = spark.sql(text.replace(" // 8", " div 8"))
    wanted = F.when(F.col("rule").isin(1, 3), F.array(F.lit("success"))).when(
        F.col("rule") == 2, F.array(F.lit("error"), F.lit("skipped")))
    needs = steps.where("step > 0").select("run_id", "step", (F.col("step") - 1).alias("on"), wanted.alias("wanted"))
    return runs.step_outcomes(steps, needs)


@query("sketch_rollup", """
select strftime(date_trunc('month', ts), '%Y-%m') as month, count(*) as n, count(distinct event_id) as n_events,
       true as distinct_ok, true as median_ok, true as p90_ok
from events group by 1
""")
def q_sketch_rollup(spark, sf_dir):
    """Daily states, stored, merged into months; the exact values in the same row judge the estimates."""
    ev = read_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path = scratch_dir(spark, "sketches") + "/days"
    sketches.sketch_states(ev, ["day"], "event_id", "value").write.parquet(path)
    month = F.date_format("day", "yyyy-MM").alias("month")
    merged = sketches.merge_states(spark.read.parquet(path), [month])
    merged = merged.select("month", "n", sketches.distinct_estimate().alias("d"),
                           sketches.quantile_estimate(0.5).alias("q50"), sketches.quantile_estimate(0.9).alias("q90"))
    # Exact shares of values below and up to each estimate, one pass over the rows.
    rows = ev.select(month, "event_id", "value").join(merged, "month")
    exact = rows.groupBy("month").agg(
        F.first("n").alias("n"), F.count_distinct("event_id").alias("n_events"), F.first("d").alias("d"),
        *[F.avg((F.col("value") < F.col(q)).cast("double")).alias(f"{q}_low") for q in ("q50", "q90")],
        *[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"{q}_high") for q in ("q50", "q90")])
    near = F.abs(F.col("d") - F.col("n_events")) <= sketches.DISTINCT_ERROR * F.col("n_events")

    def within(q, p):
        return (F.col(f"{q}_low") <= p + sketches.RANK_ERROR) & (F.col(f"{q}_high") >= p - sketches.RANK_ERROR)

    return exact.select("month", "n", "n_events", near.alias("distinct_ok"), within("q50", 0.5).alias("median_ok"),
                        within("q90", 0.9).alias("p90_ok"))


@query("sample_stratified", """
with h as (select o_orderkey, o_orderpriority, o_orderstatus,
                  row_number() over (partition by o_orderpriority, o_orderstatus
                                     order by md5('s1|' || o_orderkey::varchar)) as place,
                  count(*) over (partition by o_orderpriority, o_orderstatus) as size from orders)
select o_orderkey, o_orderpriority, o_orderstatus, size / least(size, 20) as weight from h where place <= 20
""")
def q_sample_stratified(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return sketches.sample_stratified(o, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 20, "s1")


@query("udtf_sessions", """
with e as (select *, case when lag(ts) over w > ts - interval 30 minute then 0 else 1 end as new_run
           from events window w as (partition by user_id order by ts)),
     s as (select *, sum(new_run) over (partition by user_id order by ts) as run from e)
select user_id, min(ts) as started, max(ts) as ended, count(*) as n from s group by user_id, run
""")
def q_udtf_sessions(spark, sf_dir):
    read_table(spark, sf_dir, "events").select("user_id", "ts").createOrReplaceTempView("_session_events")
    name = sessions.register(spark)
    return spark.sql(f"select * from {name}(table(_session_events), 'user_id', 'ts', 1800)")


@query("connector_roundtrip", """
select o_orderkey, o_custkey, o_totalprice, 'batch' as side from orders where o_orderkey >= 100
union all
select o_orderkey, o_custkey, o_totalprice, 'stream' from orders
""")
def q_connector_roundtrip(spark, sf_dir):
    """Two commits of orders through the Arrow connector, read back with a pushed filter and as a stream."""
    name = register_arrow(spark)
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = scratch_dir(spark, "arrow") + "/orders"
    for part in (0, 1):
        o.where(F.col("o_orderkey") % 2 == part).repartitionByRange(4, "o_orderkey").write.format(name).mode("append").save(path)
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
    batch = spark.read.format(name).schema(schema).load(path).where("o_orderkey >= 100")
    out, ckpt = streams.scratch(spark, "arrow_stream")
    streams.run_to_parquet(spark.readStream.format(name).schema(schema).load(path), out, ckpt)
    return batch.withColumn("side", F.lit("batch")).unionByName(
        spark.read.parquet(out).withColumn("side", F.lit("stream")))


@query("sql_statements", """
select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) + 0.0 as total
from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'P' group by c_mktsegment having count(*) > 1
""")
def q_sql_statements(spark, sf_dir):
    """A step of several statements: a view, a result that a later statement reads by its published name, the last result."""
    catalog.register_tables(spark, sf_dir, ["orders", "customer"])
    found = catalog.run_statements(spark, "steps_done", [
        "create or replace temporary view open_orders as select * from orders where o_orderstatus <> 'P'",
        "select c_mktsegment, o_totalprice from open_orders join customer on c_custkey = o_custkey",
        "select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) + 0.0 as total from steps_done_2 "
        "group by c_mktsegment having count(*) > 1"])
    return found["steps_done_3"]
