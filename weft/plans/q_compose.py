"""Document composition, per-key documents, chart data and reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from weft import catalog
from weft.functions.scalar import html_escape, safe_int_json
from weft.operators import compose
from weft.plans.fixtures import request_documents
from weft.plans.registry import query
from weft.sources.files import read_table


@query("compose_document", """
select '{"summary":[' || (select string_agg(to_json({o_orderpriority: o_orderpriority, n: n})::varchar, ','
                                            order by o_orderpriority)
                          from (select o_orderpriority, count(*) as n from orders group by 1)) || '],'
       || '"top":' || (select to_json({o_orderkey: o_orderkey, o_orderstatus: o_orderstatus})::varchar
                       from orders order by o_totalprice desc, o_orderkey limit 1) || ','
       || '"meta":{"source":"orders","version":2}}' as document
""")
def q_compose_document(spark, sf_dir):
    catalog.register(read_table(spark, sf_dir, "orders"), "orders")
    template = {
        "summary": {"$query": "select o_orderpriority, count(*) as n from orders group by 1",
                    "$as": "array", "$order_by": "o_orderpriority"},
        "top": {"$query": "select o_orderkey, o_orderstatus, o_totalprice from orders",
                "$as": "single", "$order_by": ["-o_totalprice", "o_orderkey"],
                "$columns": ["o_orderkey", "o_orderstatus"]},
        "_debug": {"dropped": True},
        "meta": {"source": "orders", "version": 2},
    }
    return compose.compose(spark, template)


@query("compose_array", """
select '{"nations":[' || (select string_agg(to_json({n_nationkey: n_nationkey, n_name: n_name,
                                                     n_regionkey: n_regionkey})::varchar, ',' order by n_nationkey)
                          from nation) || '],'
       || '"regions":' || (select to_json({n: count(*)})::varchar from region) || ','
       || '"none":[]}' as document
""")
def q_compose_array(spark, sf_dir):
    """Default shapes: many rows → list, one row → object, no rows → []."""
    sources = {"nation": read_table(spark, sf_dir, "nation"), "region": read_table(spark, sf_dir, "region")}
    catalog.register(sources["region"], "region")
    template = {
        "nations": {"$table": "nation", "$order_by": "n_nationkey"},
        "regions": {"$query": "select count(*) as n from region"},
        "none": {"$query": "select r_name from region where r_regionkey < 0"},
    }
    return compose.compose(spark, template, sources)


@query("compose_single", """
select (select to_json({c_custkey: c_custkey, c_name: c_name})::varchar
        from customer order by c_acctbal desc, c_custkey limit 1) as document
""")
def q_compose_single(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    template = {"$table": "customer", "$as": "single", "$order_by": ["-c_acctbal", "c_custkey"],
                "$columns": ["c_custkey", "c_name"]}
    return compose.compose(spark, template, {"customer": cust})


@query("compose_per_key", """
select o_custkey as c_custkey, count(*) as n_items,
       md5(to_json({c_custkey: o_custkey, c_name: any_value(c_name),
                    orders: list({o_orderkey: o_orderkey, o_orderstatus: o_orderstatus,
                                  o_orderpriority: o_orderpriority} order by o_orderkey)})::varchar) as doc_md5
from orders join customer on c_custkey = o_custkey
group by o_custkey
""")
def q_compose_per_key(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    docs = compose.compose_per_key(j, "c_custkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"],
                                   "o_orderkey", name="orders", head_cols=("c_name",))
    return docs.select("c_custkey", "n_items", F.md5("document").alias("doc_md5"))


@query("safe_int_json", """
select o_orderkey,
       case when abs(o_orderkey * 10000000000000) <= 9007199254740991
            then (o_orderkey * 10000000000000)::varchar
            else '"' || (o_orderkey * 10000000000000)::varchar || '"' end as json
from orders
""")
def q_safe_int_json(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("decimal(19,0)") * F.lit(Decimal(10000000000000))  # passes 64 bits from key 922,338 on
    return o.select("o_orderkey", safe_int_json(number).alias("json"))


@query("chart_data_path", """
select event_id as request_id, 1 as n_points,
       '[{"age":' || case when event_type = 'signup' then (props::json->>'k')::int - 50
                          else (props::json->>'k')::int end::varchar || '}]' as data
from events where event_type <> 'error'
""")
def q_chart_data_path(spark, sf_dir):
    docs = request_documents(spark, sf_dir).select("request_id", F.try_parse_json("doc").alias("v"))
    pts = docs.where(F.col("v").isNotNull()).select("request_id", compose.chart_data(F.col("v"), "body").alias("pts"))
    return pts.select("request_id", F.size("pts").alias("n_points"), F.to_json("pts").alias("data"))


@query("chart_bar_avg", """
select o_orderpriority, round(avg(o_totalprice), 2) + 0.0 as avg_o_totalprice from orders group by 1
""")
def q_chart_bar_avg(spark, sf_dir):
    return compose.chart_bar_avg(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("report_per_key", """
select o_custkey as c_custkey, count(*) as count,
       md5('<table>' || string_agg('<tr><td>' || o_orderkey::varchar || '</td><td>' || o_orderpriority
                                   || '</td><td>' || o_orderstatus || ' &amp; &lt;' || o_orderpriority
                                   || '&gt;</td></tr>', '' order by o_orderkey) || '</table>') as html_md5
from orders group by o_custkey
""")
def q_report_per_key(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    cells = [F.col("o_orderkey"), F.col("o_orderpriority"),
             F.concat("o_orderstatus", F.lit(" & <"), "o_orderpriority", F.lit(">"))]
    rep = compose.report_per_key(o, "c_custkey", cells, "o_orderkey")
    return rep.select("c_custkey", "count", F.md5("html").alias("html_md5"))


@query("document_keys", """
select event_id as request_id, array_to_string(json_keys(doc), ',') as keys
from (select event_id, case event_type
        when 'purchase' then '{"query":1,"body":1,"tags":1}'
        when 'click' then '{"query":1,"body":1}'
        when 'view' then '{"body":1}'
        when 'signup' then '{"query":1,"body":1}' end as doc from events) d
where doc is not null
""")
def q_document_keys(spark, sf_dir):
    docs = request_documents(spark, sf_dir)
    keys = docs.select("request_id", F.json_object_keys("doc").alias("k"))
    return keys.where(F.col("k").isNotNull()).select("request_id", F.array_join("k", ",").alias("keys"))


@query("fn_html_escape", """
select doc_id,
       md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                           '"', '&quot;'), '''', '&#039;')) as escaped_md5
from documents
""")
def q_fn_html_escape(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(html_escape("text")).alias("escaped_md5"))
