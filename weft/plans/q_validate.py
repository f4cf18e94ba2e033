"""Validation, gates on rules and column mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import gates, runs, validate
from weft.plans.fixtures import REQUEST_SCHEMA, request_documents, step_results
from weft.plans.registry import query
from weft.sources.files import read_table

_EXPECTED = """
with d as (select event_id, event_type, user_id, (props::json->>'k')::int as k from events),
e as (select event_id, case event_type
        when 'purchase' then case when k > 50 then ['data/tags/1 must be string'] else []::varchar[] end
        when 'click' then ['data/query/name must be string']
        when 'view' then ['data must have required property ''query''']
        when 'signup' then case when k - 50 < 0
             then ['data/query/name must NOT have fewer than 1 characters', 'data/body/age must be >= 0']
             else ['data/query/name must NOT have fewer than 1 characters'] end
        else ['data must be valid JSON'] end as errs
      from d)
"""


def _checked(spark, sf_dir):
    return validate.validate(request_documents(spark, sf_dir), REQUEST_SCHEMA, text="doc")


@query("validate_documents", _EXPECTED + """
select event_id as request_id, len(errs)::int as n_errors, errs[1] as first_error,
       array_to_string(errs, ', ') as error_text
from e
""")
def q_validate_documents(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "request_id", F.size("errors").alias("n_errors"), F.get(F.col("errors"), 0).alias("first_error"),
        validate.error_text().alias("error_text"))


@query("valid_rows", _EXPECTED + "select event_id as request_id from e where len(errs) = 0")
def q_valid_rows(spark, sf_dir):
    return validate.valid_rows(_checked(spark, sf_dir)).select("request_id")


@query("rejected_rows", _EXPECTED + """
select event_id as request_id, errs[1] as first_error from e where len(errs) > 0
""")
def q_rejected_rows(spark, sf_dir):
    return validate.rejected_rows(_checked(spark, sf_dir)).select(
        "request_id", F.get(F.col("errors"), 0).alias("first_error"))


@query("requests_table", """
select event_id as request_id, 'POST' as method,
       case event_type when 'purchase' then 'u' || user_id::varchar
                       when 'click' then (props::json->>'k')
                       when 'signup' then '' end as name,
       case event_type when 'signup' then (props::json->>'k')::int - 50
                       when 'error' then null else (props::json->>'k')::int end as age
from events
""")
def q_requests_table(spark, sf_dir):
    """Requests as a table with VARIANT ``query``/``body`` columns, read with path access."""
    docs = request_documents(spark, sf_dir)
    req = docs.select("request_id", "method", F.try_parse_json("doc").alias("_v")) \
        .selectExpr("request_id", "method", "_v:query as query", "_v:body as body")
    req.createOrReplaceTempView("requests")
    return spark.sql("select request_id, method, query:name::string as name, body:age::int as age from requests")


_RULES = {
    "has_rows": "total_rows > 0",
    "clean": "n_errors = 0 and g0 == 'success'",
    "retry": "n_errors > 0 or g1 = 'pending'",
    "broken": "no_such_step.status == 'success'",
    "null_is_false": "null_metric > 0",
}


@query("evaluate_rules", """
with g as (
  select user_id, 'g' || (event_id % 3)::varchar as grp,
         case when bool_or(event_type = 'error') then 'error'
              when bool_or(event_type = 'click') then 'pending'
              when bool_or(event_type = 'view') and bool_or(event_type in ('purchase', 'signup')) then 'partial'
              when bool_or(event_type = 'view') then 'skipped' else 'success' end as st
  from events group by 1, 2),
c as (select user_id, count(*) filter (where event_type = 'error') as n_errors,
             sum(round(value)::int) as total_rows from events group by 1)
select c.user_id as run_id,
       coalesce(total_rows > 0, false) as has_rows,
       coalesce(n_errors = 0 and g0.st = 'success', false) as clean,
       coalesce(n_errors > 0 or g1.st = 'pending', false) as retry,
       true as broken,
       false as null_is_false
from c
left join g g0 on g0.user_id = c.user_id and g0.grp = 'g0'
left join g g1 on g1.user_id = c.user_id and g1.grp = 'g1'
""")
def q_evaluate_rules(spark, sf_dir):
    """Run-when rules over a per-run context (step counts, group statuses); a broken
    rule fails open (runs), a null comparison counts as false."""
    steps = step_results(spark, sf_dir)
    groups = (runs.group_status(steps).groupBy("run_id")
              .pivot("group_name", ["g0", "g1", "g2"]).agg(F.first("group_status")))
    ctx = (steps.groupBy("run_id")
           .agg(F.count_if(F.col("status") == "error").alias("n_errors"),
                F.sum("row_count").alias("total_rows"))
           .join(groups, "run_id", "left")
           .withColumn("null_metric", F.lit(None).cast("int")))
    return gates.evaluate_rules(ctx, _RULES, on_error="run").select("run_id", *_RULES)


# Target attribute names of the mapping example (fixed values).
_TARGET_ATTRIBUTES = ["O_ORDERKEY", "o_TotalPrice", "o_OrderDate", "o_comment"]


@query("map_columns", """
select o_orderkey as "O_ORDERKEY", o_totalprice as "o_TotalPrice", o_orderdate as "o_OrderDate" from orders
""")
def q_map_columns(spark, sf_dir):
    """Source columns mapped case-insensitively onto target attributes; the rest is skipped."""
    o = read_table(spark, sf_dir, "orders")
    valid, _skipped = gates.map_columns(o.columns, _TARGET_ATTRIBUTES)
    target = {c.lower(): c for c in _TARGET_ATTRIBUTES}
    return o.select(*[F.col(c).alias(target[c.lower()]) for c in valid])
