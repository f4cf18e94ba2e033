"""Derived inputs built by Spark from the given tables (see FIXTURES.md §3).

All of them grow with the tables: nothing here is made-up fixed input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.frames import group_collect
from weft.session import spread_rows
from weft.sources.files import read_table

# lineitem has no unique key per order: sort on every column for a total order
LINE_FIELDS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_FIELDS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def key_text_sql(*parts: str) -> str:
    """DuckDB form of :func:`weft.functions.scalar.key_text`."""
    return " || ".join(f"coalesce(length({p}::varchar)::varchar || ':' || {p}::varchar, '~')" for p in parts)


def root_id_sql(name: str, *parts: str) -> str:
    """DuckDB form of :func:`weft.operators.nested.root_id`."""
    return f"md5('{name}|' || {key_text_sql(*parts)})"


def nested_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turns array<struct<turn, role, text>>`` ordered by turn."""
    conv = read_table(spark, sf_dir, "conversations")
    return group_collect(conv, "conv_id",
                         F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def nested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels: customer → orders → lines; customers without orders get ``[]``."""
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer")
    lines = group_collect(li, "l_orderkey", F.sort_array(F.collect_list(F.struct(*LINE_FIELDS))).alias("lines"))
    ords = (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .select("o_custkey", F.struct(*ORDER_FIELDS,
                                          F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType))
                                          .alias("lines")).alias("o")))
    per_cust = group_collect(ords, "o_custkey", F.sort_array(F.collect_list("o")).alias("orders"))
    otype = per_cust.schema["orders"].dataType
    return (cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
            .select("c_custkey", "c_name", "c_mktsegment",
                    F.coalesce("orders", F.array().cast(otype)).alias("orders")))


def events_with_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``props`` parsed into a struct (an object child)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", "event_type", F.from_json("props", "k int").alias("props"))


def step_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step log: run = user_id, steps ordered by (ts, event_id) within the run,
    group = event_id % 3, recorded status from event_type, an own condition from
    ``props.k`` (false below 10, true from 90, none between) and the executed
    outcome (``error`` events fail)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr(
        "user_id as run_id",
        "event_id",
        "ts",
        "concat('g', cast(event_id % 3 as string)) as group_name",
        "case event_type when 'error' then 'error' when 'view' then 'skipped' "
        "when 'click' then 'pending' else 'success' end as status",
        "case when event_type = 'error' then 'error' else 'success' end as outcome",
        "case when get_json_object(props, '$.k')::int < 10 then false "
        "when get_json_object(props, '$.k')::int >= 90 then true end as cond",
        "case when event_type = 'error' then concat('step ', event_id, ' failed: k=', "
        "get_json_object(props, '$.k')) end as error",
        "cast(round(value) as int) as row_count",
        "event_type = 'purchase' as is_output",
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history rows: id = user_id, flow derived from the id, status = event_type,
    seq = event_id, duration from value."""
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr("user_id as id", "concat('flow_', cast(user_id % 4 as string)) as flow",
                         "event_type as status", "ts", "event_id as seq",
                         "cast(round(value) as int) as duration")


def upsert_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keyed merge inputs from orders: the target holds orders dated before 1999,
    the change set holds orders dated from 1998 on with the price doubled, so
    1998 keys are updates and later keys are inserts."""
    o = read_table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    target = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(*cols)
    source = (o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(*cols)
              .withColumn("o_totalprice", F.col("o_totalprice") * 2))
    return target, source


def batch_responses(spark: SparkSession, sf_dir: str, batch_size: int = 500) -> DataFrame:
    """Multipart batch responses for orders planned in key order: one text per
    batch; a record fails with HTTP 400 when its key is a multiple of 7."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    from weft.operators.sync import batch_plan

    plan = batch_plan(o, "o_orderkey", batch_size)
    part = F.concat(
        F.lit("Content-Type: application/http\nContent-ID: "), (F.col("_batch_pos") + 1).cast("string"),
        F.lit("\n\nHTTP/1.1 "),
        F.when(F.col("o_orderkey") % 7 == 0,
               F.concat(F.lit('400 Bad Request\nContent-Type: application/json\n\n{"error":{"code":"0x1",'
                              '"message":"Record '), F.col("o_orderkey").cast("string"), F.lit(' rejected"}}')))
        .otherwise(F.lit("204 No Content")),
        F.lit("\n--batchresponse\n"))
    grouped = group_collect(plan, "_batch", F.sort_array(F.collect_list(F.struct("_batch_pos", part.alias("p"))))
                            .alias("_r"))
    return grouped.select("_batch", F.concat(F.lit("--batchresponse\n"),
                                             F.array_join(F.transform("_r", lambda r: r["p"]), "")).alias("response"))


# Request schema of the validation fixture (fixed values, in the shape of the API sample).
REQUEST_SCHEMA = {
    "type": "object",
    "properties": {
        "query": {"type": "object", "properties": {"name": {"type": "string", "minLength": 1}},
                  "required": ["name"]},
        "body": {"type": "object", "properties": {"age": {"type": "integer", "minimum": 0, "maximum": 150}}},
        "tags": {"type": "array", "items": {"type": "string"}},
    },
    "required": ["query"],
}


def request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: valid (purchase; an extra numeric tag when k > 50),
    wrong type (click), missing required (view), empty name and negative age
    (signup), malformed text (error). Building and checking a document is
    CPU-bound, so a scan in fewer splits than cores is spread first."""
    ev = spread_rows(read_table(spark, sf_dir, "events"))
    return ev.selectExpr("event_id as request_id", "'POST' as method", """
        case event_type
          when 'purchase' then concat('{"query":{"name":"u', user_id, '"},"body":{"age":',
                                      get_json_object(props, '$.k')::int, '},"tags":["t"',
                                      case when get_json_object(props, '$.k')::int > 50 then concat(',', get_json_object(props, '$.k')::int) else '' end, ']}')
          when 'click' then concat('{"query":{"name":', get_json_object(props, '$.k')::int, '},"body":{"age":', get_json_object(props, '$.k')::int, '}}')
          when 'view' then concat('{"body":{"age":', get_json_object(props, '$.k')::int, '}}')
          when 'signup' then concat('{"query":{"name":""},"body":{"age":', get_json_object(props, '$.k')::int - 50, '}}')
          else concat('{"query":{"name":"u', user_id, '"')
        end as doc""")
