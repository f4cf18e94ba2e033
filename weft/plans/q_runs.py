"""Step outcome, group and run history queries (G1–G11) over logs derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import runs
from weft.plans.fixtures import run_events, step_results
from weft.plans.registry import query
from weft.sinks.files import scratch_dir
from weft.sources.files import read_table
from weft.tables import SavedTable

_STEPS = """
with s as (
  select user_id as run_id, event_id, ts, 'g' || (event_id % 3)::varchar as group_name, event_type,
         case when (props::json->>'k')::int < 10 then false
              when (props::json->>'k')::int >= 90 then true end as cond,
         case when event_type = 'error' then 'error' else 'success' end as outcome
  from events)
"""


@query("group_status", """
select user_id as run_id, 'g' || (event_id % 3)::varchar as group_name,
       case when bool_or(event_type = 'error') then 'error'
            when bool_or(event_type = 'click') then 'pending'
            when bool_or(event_type = 'view') and bool_or(event_type in ('purchase', 'signup')) then 'partial'
            when bool_or(event_type = 'view') then 'skipped'
            else 'success' end as group_status
from events group by 1, 2
""")
def q_group_status(spark, sf_dir):
    return runs.group_status(step_results(spark, sf_dir))


@query("abort_propagation", _STEPS + """,
w as (select *, coalesce(max(case when cond = false or (outcome = 'error' and coalesce(cond, true))
                                  then 1 else 0 end)
                         over (partition by run_id, group_name order by ts, event_id
                               rows between unbounded preceding and 1 preceding), 0) as aborted
      from s)
select run_id, event_id,
       case when cond = false then 'skipped'
            when aborted = 1 and cond is null then 'skipped'
            else outcome end as final_status
from w
""")
def q_abort_propagation(spark, sf_dir):
    return runs.abort_propagation(step_results(spark, sf_dir)).select("run_id", "event_id", "final_status")


@query("run_first_error", """
select user_id as run_id,
       arg_min('step ' || event_id::varchar || ' failed: k=' || (props::json->>'k'), (ts, event_id))
         filter (where event_type = 'error') as first_error,
       case when bool_or(event_type = 'error') then 'error' else 'success' end as run_status
from events group by 1
""")
def q_run_first_error(spark, sf_dir):
    return runs.run_first_error(step_results(spark, sf_dir))


@query("normalise_names", """
select distinct o_orderpriority, regexp_replace(o_orderpriority, '[\\s-]', '_', 'g') as name
from orders
""")
def q_normalise_names(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderpriority", runs.normalise_name("o_orderpriority").alias("name")).distinct()


@query("run_log_append", """
select user_id as id, 'flow_' || (user_id % 4)::varchar as flow, event_type as status, ts,
       event_id as seq, round(value)::int as duration
from events
""")
def q_run_log_append(spark, sf_dir):
    """Run events appended to a history table in two writes, read back."""
    path = scratch_dir(spark, "history") + "/execution_history"
    ev = run_events(spark, sf_dir)
    ev.where(F.col("status") != "error").write.mode("append").parquet(path)
    ev.where(F.col("status") == "error").write.mode("append").parquet(path)
    return spark.read.parquet(path)


_LATEST = """
select user_id as id, 'flow_' || (user_id % 4)::varchar as flow,
       arg_max(event_type, (ts, event_id)) as status, max(ts) as ts, max(round(value)::int) as duration
from events group by 1, 2
"""


@query("run_history_latest", _LATEST + " order by ts desc limit 50")
def q_run_history_latest(spark, sf_dir):
    return runs.run_history(run_events(spark, sf_dir), ts="ts", seq="seq")


@query("run_detail", f"""
with r as ({_LATEST}), latest as (select * from r order by ts desc limit 1)
select latest.id as run_id, latest.status as run_status, e.event_id, e.event_type
from latest join events e on e.user_id = latest.id
""")
def q_run_detail(spark, sf_dir):
    """The most recent run with its steps in order."""
    state = runs.latest_state(run_events(spark, sf_dir), ts="ts", seq="seq")
    latest_id = state.orderBy(F.col("ts").desc()).limit(1).select("id").scalar()
    steps = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "event_type")
    summary = state.select(F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    return runs.run_detail(summary, steps, latest_id, order="event_id")


@query("log_truncate", """
with l as (
  select conv_id as run_id, role as step, turn as seq, text as line, strlen(text) as sz,
         coalesce(sum(strlen(text)) over (partition by conv_id, role order by turn
                  rows between unbounded preceding and 1 preceding), 0) as before
  from conversations)
select run_id, step, seq,
       case when before < 1000 and before + sz > 1000 then '[OUTPUT TRUNCATED DUE TO SIZE LIMIT]'
            else line end as line
from l
where before + sz <= 1000 or sz = 0 or (before < 1000 and before + sz > 1000)
""")
def q_log_truncate(spark, sf_dir):
    logs = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("role").alias("step"), F.col("turn").alias("seq"),
        F.col("text").alias("line"))
    return runs.log_truncate(logs, budget=1000)


@query("history_snippets", """
with h as (select conv_id, turn,
                  regexp_replace(regexp_replace(text, '[\\n\\r]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as flat
           from conversations)
select conv_id, turn,
       case when length(flat) > 50 then substring(flat, 1, 50) || '...' else flat end as snippet
from h order by conv_id desc, turn desc limit 50
""")
def q_history_snippets(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return runs.history_snippets(conv, text="text", order=("conv_id", "turn")).select("conv_id", "turn", "snippet")


@query("stop_after_output", """
with c as (select user_id, min(ts) as cut from events where event_type = 'purchase' group by 1)
select e.user_id as run_id, e.event_id
from events e left join c on c.user_id = e.user_id
where c.cut is null or e.ts <= c.cut
""")
def q_stop_after_output(spark, sf_dir):
    return runs.stop_after_output(step_results(spark, sf_dir)).select("run_id", "event_id")


@query("dry_run_rules", """
select 'g' || (event_id % 3)::varchar as group_name,
       case when (props::json->>'k')::int < 10 then 'skip' else 'run' end as action,
       count(*) as n_steps
from events group by 1, 2
""")
def q_dry_run_rules(spark, sf_dir):
    """Plan listing without running anything: each step's own run-when rule is
    evaluated with an empty context (no outputs yet), then counted per group."""
    steps = step_results(spark, sf_dir).select("group_name", "cond")
    return runs.dry_run(steps, {"will_run": "coalesce(cond, true)"}, group="group_name")


_STEP_LOG = """
select user_id::varchar as run_id, concat('flow_', (user_id % 4)::varchar) as flow,
       (row_number() over (partition by user_id order by ts, event_id) - 1)::int as cell_index,
       event_type as status, round(value)::int as duration, concat('step ', event_id::varchar) as logs, props as outputs,
       case when event_type = 'error' then concat('failed at ', event_id::varchar) end as error
from events
"""


@query("step_log", _STEP_LOG)
def q_step_log(spark, sf_dir):
    """The step log of all runs as a saved table, appended for two sets of runs and read back."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("_log_events")
    text = _STEP_LOG.replace("from events", "from _log_events").replace("::varchar", "::string")
    steps = spark.sql(text)
    table = SavedTable(spark, scratch_dir(spark, "log") + "/steps")
    for part in (0, 1):
        runs.log_steps(table, steps.where(F.pmod(F.col("run_id").cast("bigint"), F.lit(2)) == part))
    return table.read()
