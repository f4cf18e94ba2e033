"""Frame operations, user code, as-of join and table bridging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from weft import catalog
from weft.functions.scalar import to_bridge_types
from weft.operators import frames
from weft.operators.asof import join_asof
from weft.plans.registry import query
from weft.sources.files import read_table


@query("search_any_column", """
select c_custkey, c_name from customer
where contains(lower(c_custkey::varchar), 'machin') or contains(lower(c_name), 'machin')
   or contains(lower(c_nationkey::varchar), 'machin') or contains(lower(c_mktsegment), 'machin')
""")
def q_search_any_column(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return frames.search(c, "MACHIN").select("c_custkey", "c_name")


@query("page_result", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100 offset 300")
def q_page_result(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return frames.page(o, "o_orderkey", 3, 100)


@query("preview_page", """
select o_orderkey, o_orderstatus, (select count(*) from orders) as total_rows
from orders order by o_orderkey limit 100
""")
def q_preview_page(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    total = o.agg(F.count(F.lit(1))).scalar()
    return frames.page(o.select("o_orderkey", "o_orderstatus"), "o_orderkey", 0, 100) \
        .withColumn("total_rows", total)


@query("pivot_mean", """
select o_orderpriority,
       round(avg(o_totalprice) filter (where o_orderstatus = 'F'), 2) + 0.0 as "F",
       round(avg(o_totalprice) filter (where o_orderstatus = 'O'), 2) + 0.0 as "O",
       round(avg(o_totalprice) filter (where o_orderstatus = 'P'), 2) + 0.0 as "P"
from orders group by o_orderpriority
""")
def q_pivot_mean(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return frames.pivot_mean(o, "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("conditional_update", """
select c_custkey, c_mktsegment,
       round(case when c_mktsegment = 'MACHINERY' then c_acctbal * 1.2 else c_acctbal end, 2) + 0.0 as c_acctbal
from customer
""")
def q_conditional_update(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    up = frames.conditional_update(c, "c_acctbal", F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") * 1.2)
    return up.withColumn("c_acctbal", F.round("c_acctbal", 2) + 0.0)


def _band_step(tables):
    """A user step in pandas: price band and upper-cased status, row-local."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderkey": pdf["o_orderkey"],
                             "band": (pdf["o_totalprice"] // 100000).astype("int64"),
                             "status": pdf["o_orderstatus"].str.lower()})
    return frames.map_pandas(tables["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus"), fn,
                             "o_orderkey long, band long, status string")


@query("python_step", """
select o_orderkey, floor(o_totalprice / 100000)::bigint as band, lower(o_orderstatus) as status from orders
""")
def q_python_step(spark, sf_dir):
    return frames.python_step({"orders": read_table(spark, sf_dir, "orders")}, _band_step)


def _price_partials(pdf: pd.DataFrame) -> pd.DataFrame:
    g = pdf.groupby("o_custkey")
    return pd.DataFrame({"n": g.size(), "s": g["o_totalprice"].sum(), "mn": g["o_totalprice"].min(),
                         "mx": g["o_totalprice"].max()}).reset_index()


@query("grouped_pandas", """
select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) + 0.0 as total_price,
       round(max(o_totalprice) - min(o_totalprice), 2) + 0.0 as price_range, max(o_totalprice) as max_price
from orders group by o_custkey
""")
def q_grouped_pandas(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    n, s = F.col("n"), F.col("s")
    return frames.grouped_pandas_agg(
        o, "o_custkey", _price_partials, "o_custkey long, n long, s double, mn double, mx double",
        merge={"n": F.sum("n"), "s": F.sum("s"), "mn": F.min("mn"), "mx": F.max("mx")},
        finish={"n_orders": n, "total_price": F.round(s, 2) + 0.0,
                "price_range": F.round(F.col("mx") - F.col("mn"), 2) + 0.0, "max_price": F.col("mx")})


def _discounted():
    @pandas_udf("double")
    def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1.0 - discount)
    return discounted


@query("udf_scalar", """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) as net from lineitem
""")
def q_udf_scalar(spark, sf_dir):
    """A vectorised (Arrow batch) scalar UDF."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     _discounted()("l_extendedprice", "l_discount").alias("net"))


def _net_revenue():
    @pandas_udf("double")
    def net_revenue(price: pd.Series, discount: pd.Series) -> float:
        return float((price * (1.0 - discount)).sum())
    return net_revenue


@query("udaf_grouped", """
select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 as net_revenue
from lineitem group by 1, 2
""")
def q_udaf_grouped(spark, sf_dir):
    """A grouped-aggregate pandas UDF (per key and scan split), merged with a sum."""
    li = read_table(spark, sf_dir, "lineitem")
    out = frames.grouped_udaf(li, ["l_returnflag", "l_linestatus"], _net_revenue(),
                              ["l_extendedprice", "l_discount"], F.sum, "net_revenue")
    return out.withColumn("net_revenue", F.round("net_revenue", 2) + 0.0)


@udtf(returnType="line_no int, line string")
class _Lines:
    """Table function: one output row per line of a text."""

    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            yield i, line


@query("udtf_rows", """
select conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
       unnest(string_split(text, chr(10))) as line
from conversations
""")
def q_udtf_rows(spark, sf_dir):
    spark.udtf.register("text_lines", _Lines)
    catalog.register(read_table(spark, sf_dir, "conversations"), "conversations")
    return spark.sql("""select c.conv_id, c.turn, t.line_no, t.line
                        from conversations c, lateral text_lines(c.text) t""")


@query("join_asof", """
with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
     v as (select user_id, ts, event_id as view_id, value as view_value from events where event_type = 'view')
select p.event_id, p.user_id, p.ts, v.view_id, v.ts as view_ts, v.view_value
from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts
""")
def q_join_asof(spark, sf_dir):
    """Each purchase with the same user's latest view at or before it."""
    ev = read_table(spark, sf_dir, "events")
    p = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    v = ev.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"),
        F.col("value").alias("view_value"))
    return join_asof(p, v, "user_id", "ts", right_ts="view_ts", bucket_seconds=6 * 3600)


@query("union_by_name", """
select o_orderkey, o_totalprice, null::varchar as o_orderpriority from orders where o_orderstatus = 'F'
union all
select o_orderkey, null::double as o_totalprice, o_orderpriority from orders where o_orderstatus <> 'F'
""")
def q_union_by_name(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_totalprice", "o_orderkey")
    b = o.where(F.col("o_orderstatus") != "F").select("o_orderpriority", "o_orderkey")
    return a.unionByName(b, allowMissingColumns=True)


@query("bridge_types", """
select c_custkey::double as c_custkey, c_name, c_nationkey::double as c_nationkey, c_acctbal, c_mktsegment
from customer
""")
def q_bridge_types(spark, sf_dir):
    return to_bridge_types(read_table(spark, sf_dir, "customer"))


@query("lineage_stamp", """
select o_orderkey, '{"git_hash":"0a1b2c3","run_id":"run-1","cell_id":"step-4"}' as _lineage from orders
""")
def q_lineage_stamp(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return catalog.lineage_stamp(o, "0a1b2c3", "run-1", "step-4")
