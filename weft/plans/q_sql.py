"""The SQL surface (K–P): Spark SQL over the tables as views, one DuckDB oracle each.

Differences between the two dialects are written out per query (``except`` vs
``exclude``, ``rlike`` vs ``regexp_matches``, ``listagg`` vs ``string_agg``,
0- vs 1-based arrays, …). Doubles are rounded on both sides where summation
order could differ.
"""

from __future__ import annotations

from weft import catalog
from weft.plans.registry import query


def sql(name: str, spark_text: str, duck_text: str | None = None, args: dict | None = None, conf: dict | None = None):
    """Register a Spark SQL query; the oracle is ``duck_text`` or the same text. ``conf`` is read when the query
    runs, so it stays set in the session."""
    def run(spark, sf_dir):
        catalog.register_tables(spark, sf_dir)
        for key, value in (conf or {}).items():
            spark.conf.set(key, value)
        return spark.sql(spark_text, args=args) if args else spark.sql(spark_text)
    run.__name__ = f"q_{name}"
    run.__doc__ = spark_text
    query(name, duck_text if duck_text is not None else spark_text)(run)


def sql_rows_only(name: str, spark_text: str):
    def run(spark, sf_dir):
        catalog.register_tables(spark, sf_dir)
        return spark.sql(spark_text)
    run.__name__ = f"q_{name}"
    query(name)(run)


# ---------------------------------------------------------------- K: projection, filter, predicates

sql("sql_project", """
select o_orderkey, o_totalprice * 1.1 as adjusted, o_totalprice - 100 as reduced,
       upper(o_orderstatus) as status, o_custkey * 2 + 1 as odd_key
from orders""")

sql("sql_filter_param", """
select o_orderkey, o_totalprice from orders
where o_orderstatus = :status and o_totalprice > :min_price""", """
select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000""",
    args={"status": "F", "min_price": 100000})

sql("sql_case_coalesce", """
select c_custkey,
       case when c_acctbal < 0 then 'negative' when c_acctbal < 5000 then 'low' else 'high' end as band,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') as segment,
       c_nationkey::bigint * 10 as nation10, cast(c_acctbal as int) as bal_int
from customer""", """
select c_custkey,
       case when c_acctbal < 0 then 'negative' when c_acctbal < 5000 then 'low' else 'high' end as band,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') as segment,
       c_nationkey::bigint * 10 as nation10, cast(trunc(c_acctbal) as int) as bal_int
from customer""")

sql("sql_struct_access", """
select s.k, s.t, parse_json(props):k::int as pk
from (select named_struct('k', event_id, 't', event_type) as s, props from events)""", """
select s.k, s.t, (props::json->>'k')::int as pk
from (select {'k': event_id, 't': event_type} as s, props from events)""")

sql("sql_predicates", """
select p_partkey, p_name, p_size from part
where p_size in (1, 5, 10, 20) and p_retailprice between 900 and 1800
  and (p_type like '%BRASS%' or p_name rlike '^[a-m]') and p_brand is not null""", """
select p_partkey, p_name, p_size from part
where p_size in (1, 5, 10, 20) and p_retailprice between 900 and 1800
  and (p_type like '%BRASS%' or regexp_matches(p_name, '^[a-m]')) and p_brand is not null""")

sql("sql_star_except", "select * except (c_name, c_acctbal) from customer",
    "select * exclude (c_name, c_acctbal) from customer")

sql("sql_distinct", "select distinct o_orderstatus, o_orderpriority from orders")

sql("sql_recursive", """
with recursive chain(l_orderkey, n) as (
  select l_orderkey, 1 from lineitem where l_linenumber = 1
  union all
  select c.l_orderkey, c.n + 1 from chain c
  where exists (select 1 from lineitem l where l.l_orderkey = c.l_orderkey and l.l_linenumber = c.n + 1)
)
select l_orderkey, max(n) as chain_len from chain group by l_orderkey""",
    conf={"spark.sql.cteRecursionRowLimit": "-1"})  # by default a recursion fails at a million rows

sql("sql_subqueries", """
select c_custkey, c_name,
       (select count(*) from orders o where o.o_custkey = c.c_custkey) as n_orders
from customer c
where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')
  and c_nationkey in (select n_nationkey from nation where n_regionkey in (1, 3))
  and c_acctbal > (select avg(c_acctbal) from customer)""")

sql("sql_multi_step", """
with step_1 as (select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey),
     step_2 as (select c_mktsegment, round(avg(spent), 2) + 0.0 as avg_spent, count(*) as n
                from step_1 join customer on c_custkey = o_custkey group by c_mktsegment)
select * from step_2""")

sql_rows_only("sql_sample", "select o_orderkey from orders tablesample (10 percent) repeatable (42)")

# ---------------------------------------------------------------- L: joins

sql("sql_join_inner", """
select o.o_orderkey, o.o_orderdate, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_discount
from orders o join lineitem l on l.l_orderkey = o.o_orderkey""")

sql("sql_join_outer", """
select c.c_custkey, o.o_orderkey, o.o_custkey
from (select * from customer where c_nationkey < 10) c
full outer join (select * from orders where o_orderstatus = 'P') o on o.o_custkey = c.c_custkey""")

sql("sql_join_left", """
select o.o_orderkey, count(l.l_orderkey) as n_lines
from orders o left join lineitem l on l.l_orderkey = o.o_orderkey
group by o.o_orderkey""")

sql("sql_join_right", """
select s.s_suppkey, n.n_name
from (select * from supplier where s_acctbal > 0) s right join nation n on s.s_nationkey = n.n_nationkey""")

sql("sql_join_semi", """
select c_custkey, c_name from customer c left semi join orders o
  on o.o_custkey = c.c_custkey and o.o_totalprice > 400000""", """
select c_custkey, c_name from customer c semi join orders o
  on o.o_custkey = c.c_custkey and o.o_totalprice > 400000""")

sql("sql_join_anti", """
select o_orderkey from orders o left anti join lineitem l on l.l_orderkey = o.o_orderkey""", """
select o_orderkey from orders o anti join lineitem l on l.l_orderkey = o.o_orderkey""")

sql("sql_join_range", """
select o.o_orderkey, l.l_linenumber, l.l_partkey
from orders o join lineitem l
  on l.l_orderkey = o.o_orderkey
 and l.l_shipdate between o.o_orderdate and o.o_orderdate + interval 30 days""", """
select o.o_orderkey, l.l_linenumber, l.l_partkey
from orders o join lineitem l
  on l.l_orderkey = o.o_orderkey
 and l.l_shipdate between o.o_orderdate and o.o_orderdate + interval 30 days""")

# ---------------------------------------------------------------- M: aggregation

sql("sql_count_distinct", """
select l_returnflag, count(distinct l_orderkey) as n_orders, count(distinct l_partkey, l_suppkey) as n_pairs
from lineitem group by l_returnflag""", """
select l_returnflag, count(distinct l_orderkey) as n_orders, count(distinct (l_partkey, l_suppkey)) as n_pairs
from lineitem group by l_returnflag""")

sql_rows_only("sql_approx_distinct", """
select l_returnflag, approx_count_distinct(l_orderkey) as approx_orders from lineitem group by l_returnflag""")

_AGG = "count(*) as n, round(sum(l_quantity), 2) + 0.0 as qty"

sql("sql_rollup", f"""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as gid, {_AGG}
from lineitem group by rollup (l_returnflag, l_linestatus)""", f"""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::int as gid, {_AGG}
from lineitem group by rollup (l_returnflag, l_linestatus)""")

sql("sql_cube", f"""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as gid, {_AGG}
from lineitem group by cube (l_returnflag, l_linestatus)""", f"""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::int as gid, {_AGG}
from lineitem group by cube (l_returnflag, l_linestatus)""")

sql("sql_grouping_sets", f"""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as gid, {_AGG}
from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""", f"""
select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::int as gid, {_AGG}
from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""")

sql("sql_having", """
select o_custkey, count(*) as n, round(sum(o_totalprice), 2) + 0.0 as total
from orders group by all having count(*) > 12""", """
select o_custkey, count(*) as n, round(sum(o_totalprice), 2) + 0.0 as total
from orders group by all having count(*) > 12""")

sql("sql_listagg", """
select o_custkey, listagg(o_orderstatus, ',') within group (order by o_orderkey) as statuses
from orders group by o_custkey""", """
select o_custkey, string_agg(o_orderstatus, ',' order by o_orderkey) as statuses
from orders group by o_custkey""")

sql("sql_stats", """
select l_returnflag,
       round(percentile(l_quantity, 0.5), 4) + 0.0 as median_qty,
       round(stddev_samp(l_extendedprice), 2) + 0.0 as std_price,
       round(corr(l_quantity, l_extendedprice), 4) + 0.0 as corr_qp,
       min(l_discount) as min_disc, max(l_tax) as max_tax
from lineitem group by l_returnflag""", """
select l_returnflag,
       round(quantile_cont(l_quantity, 0.5), 4) + 0.0 as median_qty,
       round(stddev_samp(l_extendedprice), 2) + 0.0 as std_price,
       round(corr(l_quantity, l_extendedprice), 4) + 0.0 as corr_qp,
       min(l_discount) as min_disc, max(l_tax) as max_tax
from lineitem group by l_returnflag""")

sql("sql_pivot", """
select * from (select l_returnflag, l_linestatus, l_quantity from lineitem)
pivot (count(l_quantity) for l_linestatus in ('F' as f, 'O' as o))""", """
select l_returnflag, count(l_quantity) filter (where l_linestatus = 'F') as f,
       count(l_quantity) filter (where l_linestatus = 'O') as o
from lineitem group by l_returnflag""")

sql("sql_unpivot", """
select l_orderkey, l_linenumber, metric, val
from (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax from lineitem)
unpivot (val for metric in (l_quantity, l_extendedprice, l_tax))""", """
select l_orderkey, l_linenumber, metric, val
from (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax from lineitem)
unpivot (val for metric in (l_quantity, l_extendedprice, l_tax))""")

# ---------------------------------------------------------------- N: windows

sql("sql_window_rank", """
select o_orderkey, o_custkey,
       row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn,
       rank() over (partition by o_custkey order by o_orderpriority) as rnk,
       dense_rank() over (partition by o_custkey order by o_orderpriority) as drnk,
       ntile(4) over (partition by o_custkey order by o_orderkey) as quartile,
       round(percent_rank() over (partition by o_custkey order by o_orderkey), 6) + 0.0 as prank
from orders""")

sql("sql_window_offset", """
select o_orderkey, o_custkey,
       lag(o_orderkey) over w as prev_key, lead(o_orderkey, 2) over w as next2_key,
       first_value(o_orderkey) over w as first_key,
       last_value(o_orderkey) over (partition by o_custkey order by o_orderkey
                                    rows between unbounded preceding and unbounded following) as last_key,
       nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey
                                      rows between unbounded preceding and unbounded following) as second_key
from orders
window w as (partition by o_custkey order by o_orderkey)""")

sql("sql_window_frame", """
select o_orderkey, o_custkey,
       round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey
                                     rows between unbounded preceding and current row), 2) + 0.0 as running,
       round(avg(o_totalprice) over (partition by o_custkey order by o_orderkey
                                     rows between 2 preceding and 2 following), 4) + 0.0 as moving,
       count(*) over (partition by o_custkey order by o_orderkey
                      range between 100 preceding and current row) as near_keys
from orders""")

sql("sql_top1_per_key", """
select o_custkey, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders)
where rn = 1""", """
select o_custkey, o_orderkey, o_totalprice from orders
qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1""")

# ---------------------------------------------------------------- O: sort, limit, set operations

sql("sql_sort", """
select c_custkey, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey""")

sql("sql_top_k", """
select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""")

sql("sql_union", """
select c_nationkey as nationkey from customer union select s_nationkey from supplier
union all select n_nationkey from nation where n_regionkey = 0""")

sql("sql_intersect", """
select o_custkey from orders where o_orderstatus = 'F'
intersect all select o_custkey from orders where o_orderpriority = '1-URGENT'""")

sql("sql_except", """
select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'O'""")

# ---------------------------------------------------------------- P: scalar functions

sql("fn_regex", """
select p_partkey, regexp_replace(p_type, '[AEIOU]', '*') as masked,
       regexp_extract(p_name, '^([a-z]+)', 1) as first_word, p_type rlike 'BRASS$' as is_brass
from part""", """
select p_partkey, regexp_replace(p_type, '[AEIOU]', '*', 'g') as masked,
       regexp_extract(p_name, '^([a-z]+)', 1) as first_word, regexp_matches(p_type, 'BRASS$') as is_brass
from part""")

sql("fn_string", """
select c_custkey, lower(c_name) as lname, substring(c_name, 10, 9) as num, trim('  ' || c_mktsegment || ' ') as seg,
       split_part(c_name, '#', 2) as after_hash, concat_ws('-', c_mktsegment, c_nationkey) as tag,
       length(c_name) as len, contains(c_name, '00001') as has_1, lpad(cast(c_nationkey as string), 3, '0') as nat3
from customer""", """
select c_custkey, lower(c_name) as lname, substring(c_name, 10, 9) as num, trim('  ' || c_mktsegment || ' ') as seg,
       split_part(c_name, '#', 2) as after_hash, concat_ws('-', c_mktsegment, c_nationkey) as tag,
       length(c_name) as len, contains(c_name, '00001') as has_1, lpad(c_nationkey::varchar, 3, '0') as nat3
from customer""")

sql("fn_json", """
select event_id, get_json_object(props, '$.k') as k_text,
       to_json(named_struct('id', event_id, 'type', event_type)) as doc,
       json_object_keys(props)[0] as first_key
from events""", """
select event_id, props->>'$.k' as k_text,
       to_json({id: event_id, type: event_type})::varchar as doc,
       json_keys(props)[1] as first_key
from events""")

sql("fn_hash", """
select c_custkey, md5(c_name) as md5_name, sha2(c_name, 256) as sha_name from customer""", """
select c_custkey, md5(c_name) as md5_name, sha256(c_name) as sha_name from customer""")

sql("fn_base64", """
select c_custkey, base64(encode(c_name, 'UTF-8')) as b64,
       decode(unbase64(base64(encode(c_name, 'UTF-8'))), 'UTF-8') as back from customer""", """
select c_custkey, to_base64(encode(c_name)) as b64, decode(from_base64(to_base64(encode(c_name)))) as back
from customer""")

sql("fn_date", """
select o_orderkey, date_trunc('MONTH', o_orderdate) as month_start, year(o_orderdate) as yr,
       datediff(o_orderdate + interval 45 days, o_orderdate) as plus45,
       date_format(o_orderdate, 'yyyy-MM-dd') as day_text,
       timestampdiff(HOUR, o_orderdate, o_orderdate + interval 2 days) as hours
from orders""", """
select o_orderkey, date_trunc('month', o_orderdate) as month_start, year(o_orderdate) as yr,
       datediff('day', o_orderdate, o_orderdate + interval 45 days) as plus45,
       strftime(o_orderdate, '%Y-%m-%d') as day_text,
       datediff('hour', o_orderdate, o_orderdate + interval 2 days) as hours
from orders""")

sql("fn_math", """
select l_orderkey, l_linenumber, l_partkey, ceil(l_quantity / 7) as c7, floor(l_extendedprice / 1000) as f1000,
       least(l_discount, l_tax) as lo, greatest(l_discount, l_tax) as hi, abs(l_tax - l_discount) as gap,
       l_quantity % 4 as m4
from lineitem""")

sql("fn_array", """
select o_custkey, slice(keys, 1, 2) as first2, size(filter(keys, k -> k % 2 = 0)) as n_even,
       transform(slice(keys, 1, 3), k -> k * 10) as times10, exists(keys, k -> k > 1000) as any_big,
       forall(keys, k -> k >= 0) as all_pos, array_contains(keys, 0) as has0
from (select o_custkey, sort_array(collect_list(o_orderkey)) as keys from orders group by o_custkey)""", """
select o_custkey, keys[1:2] as first2, len(list_filter(keys, lambda k: k % 2 = 0)) as n_even,
       list_transform(keys[1:3], lambda k: k * 10) as times10, len(list_filter(keys, lambda k: k > 1000)) > 0 as any_big,
       len(list_filter(keys, lambda k: k < 0)) = 0 as all_pos, list_contains(keys, 0) as has0
from (select o_custkey, list(o_orderkey order by o_orderkey) as keys from orders group by o_custkey)""")

sql("fn_map", """
select o_custkey, m['F'] as n_f, size(map_keys(m)) as n_status,
       array_join(array_sort(map_keys(m)), ',') as statuses
from (select o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) as m
      from (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) group by o_custkey)""", """
select o_custkey, m['F'] as n_f, len(map_keys(m)) as n_status,
       array_to_string(list_sort(map_keys(m)), ',') as statuses
from (select o_custkey, map_from_entries(list({k: o_orderstatus, v: n})) as m
      from (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) group by o_custkey)""")

sql("fn_try_cast", """
select event_id, try_cast(get_json_object(props, '$.k') as int) as k,
       try_cast(event_type as int) as bad, try_cast(concat(user_id, '.5') as double) as half
from events""", """
select event_id, try_cast(props->>'$.k' as int) as k, try_cast(event_type as int) as bad,
       try_cast(user_id::varchar || '.5' as double) as half
from events""")
