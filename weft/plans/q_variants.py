"""Documents without one schema: node tables and rebuilding (irregular JSON derived from the events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.variants import rebuild_variant, shred_variant
from weft.plans.registry import query
from weft.sources.files import read_table

# Field "f" is an object, a number, an array, null or missing, by event type; members stand in key order.
_TEXT = """
  '{"f":' || case event_type
     when 'click' then '{"by":{"at":[' || event_id % 3 || ',"x"],"user":' || user_id || '},"k":' || k || '}'
     when 'view' then k when 'purchase' then '[' || k || ',[' || k || ',null],{"k":"' || k || '"},{},[]]'
     else 'null' end || ',"id":' || event_id || ',"ok":' || case when event_type = 'signup' then 'true' else 'false' end || '}'
"""
_NO_F = """ '{"id":' || event_id || ',"ok":false}' """
_DOCS = f"""select event_id, case when event_type = 'error' then {_NO_F} else {_TEXT} end as text
  from (select event_id, event_type, user_id, <k> as k from events) as e"""
_ORACLE_DOCS = _DOCS.replace("<k>", "(props::json->>'k')")


def irregular_documents(spark, sf_dir):
    """(event_id, text): one JSON document per event."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("_irregular_events")
    docs = _DOCS.replace("from events", "from _irregular_events").replace(
        "<k>", "get_json_object(props, '$.k')")
    return spark.sql(docs)


def _nodes(spark, sf_dir):
    docs = irregular_documents(spark, sf_dir)
    return shred_variant(docs.select("event_id", F.expr("try_parse_json(text)").alias("v")), "event_id")


@query("shred_variant", f"""
with d as ({_ORACLE_DOCS}),
     t as (select event_id, j.fullkey, j.path as up, j.key, j.type, j.value
           from d, json_tree(d.text::json) as j),
     n as (select *, regexp_replace(fullkey, '\\.([a-z]+)', '["\\1"]', 'g') as path,
                  regexp_matches(fullkey, '\\]$') as in_list from t)
select event_id, len(regexp_extract_all(path, '\\['))::int as depth, path,
       case when fullkey <> '$' then regexp_replace(up, '\\.([a-z]+)', '["\\1"]', 'g') end as parent,
       case when fullkey = '$' then 0 when in_list then key::int
            else (row_number() over (partition by event_id, up order by key) - 1)::int end as pos,
       case when fullkey <> '$' and not in_list then key end as key,
       case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string'
            when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind,
       case when type not in ('OBJECT', 'ARRAY') then value::varchar end as value
from n
""")
def q_shred_variant(spark, sf_dir):
    return _nodes(spark, sf_dir)


@query("rebuild_variant", f"select event_id, text, true as same from ({_ORACLE_DOCS})")
def q_rebuild_variant(spark, sf_dir):
    """Node table → documents; ``same``: the rebuilt VARIANT prints like the one that was shredded."""
    docs = irregular_documents(spark, sf_dir).select("event_id", F.expr("to_json(parse_json(text))").alias("before"))
    back = rebuild_variant(_nodes(spark, sf_dir), "event_id")
    return back.join(docs, "event_id").select("event_id", "text", (F.expr("to_json(v)") == F.col("before")).alias("same"))
