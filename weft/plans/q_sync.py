"""Write-back queries (H3–H15): key checks, merges, batch plan, payloads, outcomes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weft.operators import ledger, sync
from weft.plans.fixtures import batch_responses, key_text_sql, upsert_pair
from weft.plans.registry import query
from weft.sinks.files import scratch_dir
from weft.sources.files import read_table
from weft.tables import SavedTable

_O = "select o_orderkey, o_orderstatus, o_totalprice from orders"
_T = "o_orderdate < timestamp '1999-01-01'"
_S = "o_orderdate >= timestamp '1998-01-01'"
BATCH = 500


@query("key_violations", """
with k as (select l_orderkey, l_linenumber, count(*) as n,
                  bool_or(l_orderkey is null or l_linenumber is null) as has_null
           from lineitem group by 1, 2)
select sum(n)::bigint as total,
       coalesce(sum(n) filter (where has_null), 0)::bigint as null_keys,
       count(*) filter (where n > 1 and not has_null) as duplicate_keys
from k
""")
def q_key_violations(spark, sf_dir):
    return sync.key_violations(read_table(spark, sf_dir, "lineitem"), ["L_ORDERKEY", "l_linenumber"])


@query("sync_upsert", f"""
{_O} where {_T} and not ({_S})
union all
select o_orderkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where {_S}
""")
def q_sync_upsert(spark, sf_dir):
    target, source = upsert_pair(spark, sf_dir)
    return sync.upsert(target, source, ["o_orderkey"])


@query("sync_insert", f"""
{_O} where {_T}
union all
select o_orderkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where not ({_T}) and {_S}
""")
def q_sync_insert(spark, sf_dir):
    target, source = upsert_pair(spark, sf_dir)
    return sync.insert(target, source, ["o_orderkey"])[0]


@query("sync_update", f"""
select o_orderkey, o_orderstatus,
       case when {_S} then o_totalprice * 2 else o_totalprice end as o_totalprice
from orders where {_T}
""")
def q_sync_update(spark, sf_dir):
    target, source = upsert_pair(spark, sf_dir)
    return sync.update(target, source.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("sync_delete", f"{_O} where {_T} and not ({_S})")
def q_sync_delete(spark, sf_dir):
    target, source = upsert_pair(spark, sf_dir)
    return sync.delete(target, source, ["o_orderkey"])


@query("fill_keys", f"""
select o_orderkey,
       coalesce(case when o_orderstatus <> 'P' then o_orderkey::varchar end,
                md5({key_text_sql('o_custkey', 'o_orderdate', 'o_orderpriority')})) as record_id
from orders
""")
def q_fill_keys(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    recs = o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                    F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).alias("record_id"))
    return sync.fill_keys(recs, "record_id", ["o_custkey", "o_orderdate", "o_orderpriority"]) \
        .select("o_orderkey", "record_id")


_PLAN = f"""
with p as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
                  row_number() over (order by o_orderkey) - 1 as _idx from orders)
"""


@query("batch_plan", _PLAN + f"""
select o_orderkey, _idx, _idx // {BATCH} as _batch, (_idx % {BATCH})::int as _batch_pos from p
""")
def q_batch_plan(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return sync.batch_plan(o, "o_orderkey", BATCH).select("o_orderkey", "_idx", "_batch", "_batch_pos")


@query("batch_payloads", _PLAN + f"""
select _idx // {BATCH} as _batch, min(_idx) as first_idx, count(*) as n_records,
       md5(string_agg(to_json({{o_orderkey: o_orderkey, o_custkey: o_custkey, o_orderstatus: o_orderstatus,
                                o_orderpriority: o_orderpriority}})::varchar, chr(10) order by _idx)) as payload_md5
from p group by 1
""")
def q_batch_payloads(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    plan = sync.batch_plan(o, "o_orderkey", BATCH)
    pay = sync.batch_payloads(plan, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return pay.select("_batch", "first_idx", "n_records", F.md5("payload").alias("payload_md5"))


@query("key_segment", """
select c_custkey,
       c_custkey::varchar as primary_segment,
       'c_mktsegment=''' || replace(c_mktsegment || '''s', '''', '''''') || ''',c_custkey=' || c_custkey::varchar
         as alternate_segment
from customer
""")
def q_key_segment(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("'s")))
    return c.select("c_custkey", sync.key_segment(c, ["c_custkey"], primary=True).alias("primary_segment"),
                    sync.key_segment(c, ["c_mktsegment", "c_custkey"]).alias("alternate_segment"))


def fake_transport(batch: int, payload: str) -> str:
    """Stand-in for the remote endpoint: rejects records whose key is a multiple of 7."""
    parts = ["--batchresponse"]
    for i, line in enumerate(payload.split("\n"), start=1):
        key = json.loads(line)["o_orderkey"]
        if key % 7 == 0:
            body = ('HTTP/1.1 400 Bad Request\nContent-Type: application/json\n\n'
                    + json.dumps({"error": {"code": "0x1", "message": f"Record {key} rejected"}}))
        else:
            body = "HTTP/1.1 204 No Content"
        parts.append(f"Content-Type: application/http\nContent-ID: {i}\n\n{body}\n--batchresponse")
    return "\n".join(parts) + "--"


_OUTCOMES = _PLAN + """
select o_orderkey, _idx, case when o_orderkey % 7 = 0 then 400 else 204 end as status,
       o_orderkey % 7 <> 0 as ok,
       case when o_orderkey % 7 = 0 then 'Record ' || o_orderkey::varchar || ' rejected' end as message,
       'o_orderkey=' || o_orderkey::varchar as record_key
from p
"""


def _outcome_rows(plan, outcomes):
    return (sync.outcomes_with_records(outcomes, plan, ["o_orderkey"])
            .select("o_orderkey", "_idx", "status", "ok", "message", "record_key"))


@query("batch_send", _OUTCOMES)
def q_batch_send(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    plan = sync.batch_plan(o, "o_orderkey", BATCH)
    payloads = sync.batch_payloads(plan, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    responses = sync.batch_send(payloads, fake_transport)
    return _outcome_rows(plan, sync.batch_outcomes(responses, BATCH))


@query("batch_outcomes", _OUTCOMES)
def q_batch_outcomes(spark, sf_dir):
    plan = sync.batch_plan(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", BATCH)
    return _outcome_rows(plan, sync.batch_outcomes(batch_responses(spark, sf_dir, BATCH), BATCH))


@query("sync_summary", """
select count(*) as total, count(*) filter (where o_orderkey % 7 <> 0) as succeeded,
       count(*) filter (where o_orderkey % 7 = 0) as failed, 0::bigint as skipped
from orders
""")
def q_sync_summary(spark, sf_dir):
    plan = sync.batch_plan(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", BATCH)
    return sync.sync_summary(sync.batch_outcomes(batch_responses(spark, sf_dir, BATCH), BATCH), plan)


@query("sync_resume", f"""
with s as (select * from orders where {_S})
select 1 as run, o_orderkey, {_T} as ok, case when not ({_T}) then 'key is not in the target' end as message from s
union all
select 2 as run, o_orderkey, true as ok, null as message from s where not ({_T})
""")
def q_sync_resume(spark, sf_dir):
    """Update-only, then upsert, then upsert again over one ledger: the second run sends only what the first could
    not deliver, the third sends nothing."""
    target, source = upsert_pair(spark, sf_dir)
    root = scratch_dir(spark, "sync")
    saved, book = SavedTable(spark, f"{root}/target"), ledger.open_ledger(spark, f"{root}/ledger")
    saved.create(target)
    for mode in ("update", "upsert", "upsert"):
        ledger.sync(source, saved, book, ["o_orderkey"], mode, BATCH)
    key = F.regexp_extract("record_key", "^\\d+:(.*)$", 1).cast("bigint")
    return book.read().select("run", key.alias("o_orderkey"), "ok", "message")


@query("sync_newest", f"""
{_O} where {_T} and not ({_S})
union all
select o_orderkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where {_S}
""")
def q_sync_newest(spark, sf_dir):
    """A source that repeats every key, each time with an older price: the newest change wins."""
    target, source = upsert_pair(spark, sf_dir)
    both = source.withColumn("changed", F.lit(2)).unionByName(
        source.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("changed", F.lit(1)))
    return sync.upsert(target, both, ["o_orderkey"], order="changed")


@query("table_evolve", """
select 0 as version, o_orderkey, o_orderstatus, null::varchar as channel from orders where o_orderkey % 3 = 0
union all
select 2, o_orderkey, o_orderstatus, case when o_orderkey % 3 = 0 then 'store' else 'web' end
from orders where o_orderkey % 3 <= 1
""")
def q_table_evolve(spark, sf_dir):
    """A saved table gets a column and rows; both the old and the new version are read."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    table = SavedTable(spark, scratch_dir(spark, "evolve") + "/orders")
    table.create(o.where("o_orderkey % 3 = 0"))
    table.add_column("channel", "string", "store")
    table.insert(o.where("o_orderkey % 3 = 1").withColumn("channel", F.lit("web")))
    old = table.read(0).withColumn("channel", F.lit(None).cast("string")).withColumn("version", F.lit(0))
    return old.unionByName(table.read(2).withColumn("version", F.lit(2))).select(
        "version", "o_orderkey", "o_orderstatus", "channel")
