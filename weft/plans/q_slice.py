"""The first slice end to end (sales gate on orders) and the plain table I/O keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import catalog
from weft.operators.gates import gated, gated_with_fallback, empty_like, quality_metrics
from weft.plans.registry import query
from weft.sinks.files import scratch_dir, write_parquet
from weft.sources.files import read_table


def _orders_gate(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    metrics = quality_metrics(orders, bad_price=F.col("o_totalprice") <= 0)
    return orders, metrics


@query("quality_metrics", """
select count(*) as total,
       count(*) filter (where o_totalprice <= 0) as bad_price
from orders
""")
def q_quality_metrics(spark, sf_dir):
    return _orders_gate(spark, sf_dir)[1]


@query("gated_transform", """
with m as (select count(*) filter (where o_totalprice <= 0) as bad_price from orders)
select o_orderpriority,
       count(*) as n_orders,
       round(avg(o_totalprice * 1.1), 2) + 0.0 as avg_adjusted
from orders, m
where m.bad_price = 0
group by o_orderpriority
""")
def q_gated_transform(spark, sf_dir):
    orders, metrics = _orders_gate(spark, sf_dir)
    adjusted = orders.withColumn("adjusted", F.col("o_totalprice") * 1.1)
    return (gated(adjusted, metrics, "bad_price = 0")
            .groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 (F.round(F.avg("adjusted"), 2) + 0.0).alias("avg_adjusted")))


@query("gate_fallback_empty", """
with m as (select count(*) filter (where o_totalprice > 0) as n_positive from orders)
select o_orderpriority, count(*) as n_orders
from orders, m
where m.n_positive = 0
group by o_orderpriority
""")
def q_gate_fallback_empty(spark, sf_dir):
    """Gate that fails on this data (it demands no positive prices): the rollback
    branch publishes an empty summary with the main branch's schema."""
    orders = read_table(spark, sf_dir, "orders")
    metrics = quality_metrics(orders, n_positive=F.col("o_totalprice") > 0)
    summary = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    return gated_with_fallback(summary, empty_like(summary), metrics, "n_positive = 0")


@query("sql_group_agg", """
select l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) + 0.0 as sum_qty,
       round(sum(l_extendedprice), 2) + 0.0 as sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 as sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) + 0.0 as sum_charge,
       round(avg(l_quantity), 4) + 0.0 as avg_qty,
       round(avg(l_extendedprice), 4) + 0.0 as avg_price,
       round(avg(l_discount), 6) + 0.0 as avg_disc,
       count(*) as count_order
from lineitem
group by l_returnflag, l_linestatus
""")
def q_sql_group_agg(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r = lambda c, d: (F.round(c, d) + 0.0)
    return (li.groupBy("l_returnflag", "l_linestatus")
            .agg(r(F.sum("l_quantity"), 2).alias("sum_qty"),
                 r(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
                 r(F.sum(disc), 2).alias("sum_disc_price"),
                 r(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
                 r(F.avg("l_quantity"), 4).alias("avg_qty"),
                 r(F.avg("l_extendedprice"), 4).alias("avg_price"),
                 r(F.avg("l_discount"), 6).alias("avg_disc"),
                 F.count(F.lit(1)).alias("count_order")))


@query("ingest_parquet", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def q_ingest_parquet(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("load_table", "select c_custkey, c_name, c_nationkey from customer")
def q_load_table(spark, sf_dir):
    catalog.register(read_table(spark, sf_dir, "customer"), "customer")
    return catalog.load(spark, "customer").select("c_custkey", "c_name", "c_nationkey")


@query("query_all_tables", """
select n.n_name, r.r_name, count(*) as n_customers
from customer c join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
group by n.n_name, r.r_name
""")
def q_query_all_tables(spark, sf_dir):
    catalog.register_tables(spark, sf_dir)
    return spark.sql("""
        select n.n_name, r.r_name, count(*) as n_customers
        from customer c join nation n on c.c_nationkey = n.n_nationkey
        join region r on n.n_regionkey = r.r_regionkey
        group by n.n_name, r.r_name""")


@query("register_result", """
select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) + 0.0 as total
from orders group by o_orderstatus
""")
def q_register_result(spark, sf_dir):
    catalog.register(read_table(spark, sf_dir, "orders"), "orders")
    step = spark.sql("""with s as (select o_orderstatus, o_totalprice from orders)
                        select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) + 0.0 as total
                        from s group by o_orderstatus""")
    catalog.register(step, "status_summary")
    return spark.table("status_summary")


@query("save_load_roundtrip", """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate from lineitem
""")
def q_save_load_roundtrip(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    return catalog.save(li, "lineitem_saved", scratch_dir(spark, "catalog"))


@query("export_parquet", """
select o_orderpriority, count(*) as n_orders, round(avg(o_totalprice), 2) + 0.0 as avg_price
from orders group by o_orderpriority
""")
def q_export_parquet(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    summary = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"),
                                              (F.round(F.avg("o_totalprice"), 2) + 0.0).alias("avg_price"))
    path = write_parquet(summary, scratch_dir(spark, "export") + "/summary")
    return spark.read.parquet(path)
