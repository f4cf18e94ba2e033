"""Sources, sinks and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import catalog
from weft.plans.registry import query
from weft.sinks.files import markdown_rows, scratch_dir, write_csv, write_json
from weft.sources.custom import read_rowgroups
from weft.sources.files import TABLE_NAMES, read_csv, read_json, read_table, table_path


@query("ingest_csv", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def q_ingest_csv(spark, sf_dir):
    """CSV with a header, types detected from the data."""
    path = scratch_dir(spark, "csv") + "/orders"
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o.write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("export_csv", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def q_export_csv(spark, sf_dir):
    path = write_csv(read_table(spark, sf_dir, "customer"), scratch_dir(spark, "export") + "/customer.csv")
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return read_csv(spark, path, schema=schema)


@query("export_json", "select event_id, user_id, event_type, value, props from events")
def q_export_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = write_json(ev, scratch_dir(spark, "export") + "/events.json")
    return read_json(spark, path, schema="event_id bigint, user_id bigint, event_type string, value double, "
                                         "props string")


@query("markdown_rows", """
select '| ' || conv_id::varchar || ' | ' || turn::varchar || ' | ' || role || ' | '
       || regexp_replace(replace(text, '|', '\\|'), '\\r?\\n', ' ', 'g') || ' |' as line
from conversations
""")
def q_markdown_rows(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return markdown_rows(conv)


def _columns(spark, sf_dir):
    catalog.register_tables(spark, sf_dir)
    return catalog.catalog_columns(spark, set(TABLE_NAMES))


@query("catalog_columns", """
select table_name, column_name, ordinal_position::int as ordinal_position
from information_schema.columns
where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                     'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
""")
def q_catalog_columns(spark, sf_dir):
    return _columns(spark, sf_dir).select("table_name", "column_name", "ordinal_position")


@query("shared_columns", """
select column_name, count(distinct table_name) as n_tables
from information_schema.columns
where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                     'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
group by column_name having count(distinct table_name) > 1
""")
def q_shared_columns(spark, sf_dir):
    return catalog.shared_columns(_columns(spark, sf_dir))


@query("table_columns", """
select table_name, string_agg(column_name, ',' order by ordinal_position) as columns
from information_schema.columns
where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                     'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
group by table_name
""")
def q_table_columns(spark, sf_dir):
    t = catalog.table_columns(_columns(spark, sf_dir))
    return t.select("table_name", F.array_join("columns", ",").alias("columns"))


@query("values_source", """
select v.label, count(*) as n_orders
from orders o join (values ('F', 'finished'), ('O', 'open'), ('P', 'partial')) v(code, label)
  on o.o_orderstatus = v.code
group by v.label
""")
def q_values_source(spark, sf_dir):
    """Inline rows (``VALUES``) as a lookup joined to a table."""
    catalog.register(read_table(spark, sf_dir, "orders"), "orders")
    return spark.sql("""
        select v.label, count(*) as n_orders
        from orders o join (values ('F', 'finished'), ('O', 'open'), ('P', 'partial')) as v(code, label)
          on o.o_orderstatus = v.code
        group by v.label""")


@query("custom_source", "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders")
def q_custom_source(spark, sf_dir):
    """The connector contract: a Python data source reading row groups in parallel."""
    return read_rowgroups(spark, table_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("list_tables", "\nunion all\n".join(
    f"select '{t}' as name, true as is_temporary, count(*) as n_rows from {t}" for t in TABLE_NAMES))
def q_list_tables(spark, sf_dir):
    """Published tables with their row counts (one job, a partial count per scan task)."""
    catalog.register_tables(spark, sf_dir)
    return catalog.list_tables(spark, set(TABLE_NAMES), with_counts=True)


@query("lineage_log", """
select 'input' as direction, 'weft' as namespace, 'orders' as name, count(*) as n_rows from orders
union all
select 'input', 'weft', 'lineitem', count(*) from lineitem
union all
select 'output', 'weft', 'priority_revenue', count(*)
from (select o_orderpriority from orders join lineitem on l_orderkey = o_orderkey group by 1)
""")
def q_lineage_log(spark, sf_dir):
    """A step's inputs and its saved output, with row counts, as lineage rows."""
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    step = (orders.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_orderpriority")
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))
    saved = catalog.save(step, "priority_revenue", scratch_dir(spark, "lineage"))
    return catalog.lineage_log({"orders": orders, "lineitem": lineitem}, "priority_revenue", saved).select(
        "direction", "namespace", "name", "n_rows")
