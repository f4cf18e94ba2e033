"""Shred / rebuild queries over nested documents that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import catalog
from weft.operators.nested import rebuild, rebuild_local, save_bucketed, shred
from weft.plans.fixtures import (
    LINE_FIELDS,
    events_with_props,
    nested_conversations,
    nested_customers,
    root_id_sql,
)
from weft.plans.registry import query
from weft.sinks.files import scratch_dir
from weft.sources.files import read_json, read_json_variant, read_table

_CONV_ID = root_id_sql("conv", "conv_id")
_CONV_POS = "(row_number() over (partition by conv_id order by turn) - 1)"
_LINE_ORDER = ", ".join(LINE_FIELDS)

CHILD_TURNS_SQL = f"""
select md5(concat_ws('|', {_CONV_ID}, 'turns', {_CONV_POS}::varchar)) as _row_id,
       {_CONV_ID} as _parent_id,
       {_CONV_POS}::int as _pos,
       turn, role, text, '{{}}' as _children
from conversations
"""


def _customers_shredded(spark, sf_dir, depth_limit=5):
    return shred(nested_customers(spark, sf_dir), "cust", key_cols=["c_custkey"], depth_limit=depth_limit)


def _saved(parts, spark):
    """Shredded tables written once to Parquet (what a saved nested table is)."""
    root = scratch_dir(spark, "shred")
    out = type(parts)(parts.root, parts.layout)
    for name, df in parts.items():
        out[name] = catalog.save(df, name, root)
    return out


@query("shred_root", f"""
select {_CONV_ID} as _row_id, conv_id,
       '{{"turns":{{"type":"array","table":"conv_turns","state":"present"}}}}' as _children
from (select distinct conv_id from conversations)
""")
def q_shred_root(spark, sf_dir):
    return shred(nested_conversations(spark, sf_dir), "conv", key_cols=["conv_id"])["conv"]


@query("shred_child", CHILD_TURNS_SQL)
def q_shred_child(spark, sf_dir):
    return shred(nested_conversations(spark, sf_dir), "conv", key_cols=["conv_id"])["conv_turns"]


_CUST_ID = root_id_sql("cust", "o_custkey")
_ORDER_ID = (f"md5(concat_ws('|', {_CUST_ID}, 'orders', "
             "(row_number() over (partition by o_custkey order by o_orderkey) - 1)::varchar))")


@query("shred_grandchild", f"""
with ch as (select {_ORDER_ID} as rid, o_orderkey from orders),
     l as (select *, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) - 1 as p
           from lineitem)
select md5(concat_ws('|', rid, 'lines', p::varchar)) as _row_id, rid as _parent_id, p::int as _pos,
       {_LINE_ORDER}, '{{}}' as _children
from l join ch on l_orderkey = o_orderkey
""")
def q_shred_grandchild(spark, sf_dir):
    return _customers_shredded(spark, sf_dir)["cust_orders_lines"]


_EVENT_ID = root_id_sql("ev", "event_id")


@query("shred_struct", f"""
select md5(concat_ws('|', {_EVENT_ID}, 'props', '0')) as _row_id,
       {_EVENT_ID} as _parent_id,
       0 as _pos, (props::json->>'k')::int as k, '{{}}' as _children
from events where props is not null
""")
def q_shred_struct(spark, sf_dir):
    return shred(events_with_props(spark, sf_dir), "ev", key_cols=["event_id"])["ev_props"]


_VEC_ID = root_id_sql("emb", "vec_id")


@query("shred_primitive_array", f"""
with e as (select vec_id, generate_subscripts(embedding, 1) - 1 as p, unnest(embedding) as value
           from embeddings)
select md5(concat_ws('|', {_VEC_ID}, 'embedding', p::varchar)) as _row_id,
       {_VEC_ID} as _parent_id, p::int as _pos, value, '{{}}' as _children
from e
""")
def q_shred_primitive_array(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return shred(emb, "emb", key_cols=["vec_id"])["emb_embedding"]


@query("shred_depth_limit", f"""
with n as (select l_orderkey, count(*) as n_lines from lineitem group by l_orderkey)
select {_ORDER_ID} as _row_id,
       {_CUST_ID} as _parent_id,
       (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as _pos,
       o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       '{{"lines":{{"type":"array","table":"cust_orders_lines","state":"'
         || case when n.n_lines > 0 then 'present' else 'empty' end || '"}}}}' as _children
from orders left join n on l_orderkey = o_orderkey
""")
def q_shred_depth_limit(spark, sf_dir):
    """Depth limit 2: the lines below orders are cut; the parent still names their table."""
    parts = _customers_shredded(spark, sf_dir, depth_limit=2)
    assert "cust_orders_lines" not in parts
    return parts["cust_orders"]


_REBUILD_ORACLE = f"""
with l as (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by l_orderkey),
     seq as (select o_custkey,
                    string_agg(l_linenumber::varchar, ',' order by o_orderkey, {_LINE_ORDER}) as line_seq
             from orders join lineitem on l_orderkey = o_orderkey group by o_custkey),
     o as (select o_custkey, count(*) as n_orders, coalesce(sum(l.n), 0) as n_lines,
                  string_agg(o_orderkey::varchar, ',' order by o_orderkey) as order_keys,
                  coalesce(sum(l.q), 0) as qty
           from orders left join l on l_orderkey = o_orderkey group by o_custkey)
select c_custkey, c_name,
       coalesce(n_orders, 0)::int as n_orders, coalesce(n_lines, 0)::int as n_lines,
       coalesce(order_keys, '') as order_keys, coalesce(line_seq, '') as line_seq,
       round(coalesce(qty, 0), 2) + 0.0 as qty
from customer left join o on o.o_custkey = c_custkey left join seq on seq.o_custkey = c_custkey
"""


def rebuilt_summary(docs):
    orders = F.col("orders")
    lines = F.flatten(F.transform(orders, lambda o: o["lines"]))
    return docs.select(
        "c_custkey", "c_name",
        F.size(orders).alias("n_orders"),
        F.size(lines).alias("n_lines"),
        F.array_join(F.transform(orders, lambda o: o["o_orderkey"].cast("string")), ",").alias("order_keys"),
        F.array_join(F.transform(lines, lambda x: x["l_linenumber"].cast("string")), ",").alias("line_seq"),
        (F.round(F.aggregate(lines, F.lit(0.0), lambda acc, x: acc + x["l_quantity"]), 2) + 0.0).alias("qty"),
    )


@query("rebuild_nested", _REBUILD_ORACLE)
def q_rebuild_nested(spark, sf_dir):
    """Shred customers → orders → lines, save the tables, rebuild from the saved files.

    The nested documents are written once first: each shredded table is its own
    write job, and without the saved input every one of them would rebuild the
    documents (two joins, two shuffles) again."""
    docs = catalog.save(nested_customers(spark, sf_dir), "cust_docs", scratch_dir(spark, "docs"))
    parts = _saved(shred(docs, "cust", key_cols=["c_custkey"], root_ids=True), spark)
    return rebuilt_summary(rebuild(parts))


@query("rebuild_bucketed", _REBUILD_ORACLE)
def q_rebuild_bucketed(spark, sf_dir):
    """The same documents from tables saved bucketed by document: rows move once, when saved, and the
    rebuild reads, groups and nests without an exchange at any level."""
    docs = catalog.save(nested_customers(spark, sf_dir), "cust_docs", scratch_dir(spark, "docs"))
    parts = save_bucketed(shred(docs, "cust", key_cols=["c_custkey"], root_ids=True), scratch_dir(spark, "bucketed"))
    return rebuilt_summary(rebuild_local(parts))


@query("rebuild_empty", """
select o_orderkey, 0 as n_lines, false as lines_is_null
from orders where o_orderkey not in (select l_orderkey from lineitem)
""")
def q_rebuild_empty(spark, sf_dir):
    """Orders without line items come back with ``lines = []`` (not null)."""
    docs = rebuild(_customers_shredded(spark, sf_dir))
    orders = docs.select(F.explode("orders").alias("o"))
    return (orders.where(F.coalesce(F.size("o.lines"), F.lit(0)) <= 0)
            .select("o.o_orderkey", F.size("o.lines").alias("n_lines"),
                    F.col("o.lines").isNull().alias("lines_is_null")))


@query("query_deep_child", """
select o.o_orderpriority, l.l_returnflag, count(*) as n_lines,
       round(sum(l.l_quantity), 2) + 0.0 as qty
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
group by o.o_orderpriority, l.l_returnflag
""")
def q_query_deep_child(spark, sf_dir):
    parts = _customers_shredded(spark, sf_dir)
    catalog.register(parts["cust_orders"], "cust_orders")
    catalog.register(parts["cust_orders_lines"], "cust_orders_lines")
    return spark.sql("""
        select o.o_orderpriority, l.l_returnflag, count(*) as n_lines,
               round(sum(l.l_quantity), 2) + 0.0 as qty
        from cust_orders_lines l join cust_orders o on l._parent_id = o._row_id
        group by o.o_orderpriority, l.l_returnflag""")


@query("shred_roundtrip", "select count(*) as n_rows, 0::bigint as n_diff from customer")
def q_shred_roundtrip(spark, sf_dir):
    """rebuild(shred(x)) == x over every customer document (0 differing rows)."""
    docs = nested_customers(spark, sf_dir)
    back = rebuild(shred(docs, "cust", key_cols=["c_custkey"]))
    sig = lambda d, n: d.select("c_custkey", F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns]))).alias(n))
    both = sig(docs, "a").join(sig(back, "b"), "c_custkey", "full")
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(~F.equal_null(F.col("a"), F.col("b"))).alias("n_diff"))


@query("ingest_json_shred", CHILD_TURNS_SQL)
def q_ingest_json_shred(spark, sf_dir):
    """Nested documents as JSON lines on disk → read (inferred) → routed to
    shredding because they are nested → linked tables saved and published."""
    path = scratch_dir(spark, "json") + "/conversations"
    nested_conversations(spark, sf_dir).write.json(path)
    docs = read_json(spark, path)
    return catalog.save_auto(docs, "conv", scratch_dir(spark, "ingest"), key_cols=["conv_id"])["conv_turns"]


# Shapes given to one field, by event type (fixed values of the irregular fixture).
_IRREGULAR = {"click": "object", "view": "number", "purchase": "array", "signup": "null", "error": "missing"}


@query("ingest_variant", """
select event_id as id,
       case event_type when 'click' then 'object' when 'view' then 'number'
            when 'purchase' then 'array' when 'signup' then 'null' else 'missing' end as kind,
       case when event_type in ('click', 'view', 'purchase') then (props::json->>'k')::int end as k
from events
""")
def q_ingest_variant(spark, sf_dir):
    """Irregular JSON (one field is an object, number, array, null or missing)
    read as VARIANT, then typed per row."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    f = (F.when(F.col("event_type") == "click", F.concat(F.lit('{"k":'), k, F.lit("}")))
         .when(F.col("event_type") == "view", k)
         .when(F.col("event_type") == "purchase", F.concat(F.lit("["), k, F.lit("]")))
         .when(F.col("event_type") == "signup", F.lit("null")))
    text = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"),
                    F.when(f.isNotNull(), F.concat(F.lit(',"f":'), f)).otherwise(F.lit("")), F.lit("}"))
    path = scratch_dir(spark, "variant") + "/docs"
    ev.select(text.alias("value")).write.text(path)
    v = read_json_variant(spark, path)
    return v.selectExpr(
        "try_variant_get(v, '$.id', 'bigint') as id",
        """case when v:f is null then 'missing'
                when is_variant_null(v:f) then 'null'
                when schema_of_variant(v:f) like 'OBJECT%' then 'object'
                when schema_of_variant(v:f) like 'ARRAY%' then 'array'
                else 'number' end as kind""",
        """coalesce(try_variant_get(v, '$.f.k', 'int'), try_variant_get(v, '$.f[0]', 'int'),
                    try_variant_get(v, '$.f', 'int')) as k""",
    )
