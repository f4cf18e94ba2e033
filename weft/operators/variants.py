"""Shred documents without a common schema into a node table, and rebuild them.

``shred_variant`` takes one VARIANT per document and gives one row per node: the
document, the node's ``path`` and its ``parent``'s, ``depth``, position and key in
the parent, ``kind`` (object, array, string, number, boolean, null, missing) and, for
scalars, the value as JSON text. A field may be a scalar in one document, an object
in the next and an array in a third; empty objects and arrays keep a row of
their own. Levels are unfolded with ``variant_explode`` until no node has children, and each
level is written once, so a deep document does not repeat the work above it.

``rebuild_variant`` is the inverse. Every level's rows meet their children's texts in one
grouping; all groupings are local to the document's partition, so each row is
shuffled once whatever the depth.

Paths quote and escape keys (``$["a"][3]["b.c"]``), so no two nodes of a document share
one. Object members are in key order, which is how a VARIANT stores them. Documents
must have distinct ids: ``rebuild_variant`` raises on a repeated one instead of mixing
two documents. A null VARIANT (malformed text) is a root of kind ``missing`` and comes back null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut_lineage

NODE = ("depth", "path", "parent", "pos", "key", "kind", "value")
ROOT = "$"


def _quoted(key: Column) -> Column:
    """JSON text of a string: the element of a one-element JSON array without its brackets."""
    text = F.to_json(F.array(key))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _kind(v: str) -> Column:
    return F.expr(f"""case when {v} is null then 'missing' when is_variant_null({v}) then 'null'
        when try_variant_get({v}, '$', 'map<string,variant>') is not null then 'object'
        when try_variant_get({v}, '$', 'array<variant>') is not null then 'array'
        when schema_of_variant({v}) = 'STRING' then 'string' when schema_of_variant({v}) = 'BOOLEAN' then 'boolean'
        else 'number' end""")


def shred_variant(docs: DataFrame, doc_id: str, v: str = "v", depth_limit: int | None = None) -> DataFrame:
    """(``doc_id``, :data:`NODE`...) of the documents ``v``. Subtrees below ``depth_limit`` levels stay as
    one node of kind ``json`` with their text."""
    spark = docs.sparkSession
    level = docs.select(F.col(doc_id).alias("_doc"), F.lit(0).alias("depth"), F.lit(ROOT).alias("path"),
                        F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"),
                        F.lit(None).cast("string").alias("key"), F.col(v).alias("_v"))
    levels = []
    for depth in range(depth_limit or 1 << 30):
        level = cut_lineage(level.withColumn("kind", _kind("_v")))
        inner = F.col("kind").isin("object", "array")
        deepest = depth_limit is not None and depth + 1 == depth_limit
        if deepest:
            level = level.withColumn("kind", F.when(inner, "json").otherwise(F.col("kind")))
            inner = F.col("kind").isin("object", "array")
        text = F.when(~inner & (F.col("kind") != "missing"), F.to_json("_v"))
        levels.append(level.select(F.col("_doc").alias(doc_id), *NODE[:-1], text.alias("value")))
        nested = level.where(inner)
        if nested.isEmpty():
            break
        nested = nested.select("_doc", "depth", F.col("path").alias("_up"), (F.col("kind") == "array").alias("_list"), "_v")
        step = F.when(F.col("_list"), F.col("pos").cast("string")).otherwise(_quoted(F.col("key")))
        level = nested.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(
            "_doc", (F.col("depth") + 1).alias("depth"), F.concat("_up", F.lit("["), step, F.lit("]")).alias("path"),
            F.col("_up").alias("parent"), "pos", "key", F.col("value").alias("_v"))
    return reduce(DataFrame.unionByName, levels)


def rebuild_variant(nodes: DataFrame, doc_id: str) -> DataFrame:
    """(``doc_id``, ``text``, ``v``): the documents of a node table, as JSON text and as VARIANT."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select(doc_id, F.lit(None).cast("string").alias("text")).withColumn("v", F.expr("try_parse_json(text)"))
    rows = nodes.select(F.col(doc_id).alias("_doc"), *NODE).repartition("_doc")
    child = "struct<pos: int, key: string, text: string>"
    up = None
    for depth in range(deepest, -1, -1):
        # Spark knows a union's partitioning by its inputs' own columns, so the key is named anew.
        met = rows.where(F.col("depth") == depth).select(F.col("_doc").alias("_d"), *NODE, F.lit(None).cast(child).alias("_child"))
        if up is not None:
            blank = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in NODE if c != "path"]
            under = up.select(F.col("_doc").alias("_d"), F.col("parent").alias("path"), *blank,
                              F.struct("pos", "key", "text").cast(child).alias("_child"))
            met = met.unionByName(under)
        kept = [F.max(c).alias(c) for c in NODE if c != "path"]
        met = met.groupBy("_d", "path").agg(*kept, F.count("kind").alias("_own"),
                                              F.sort_array(F.collect_list("_child")).alias("_children"))
        body = F.when(F.col("kind") == "array", F.concat(
            F.lit("["), F.array_join(F.transform("_children", lambda c: c["text"]), ","), F.lit("]")))
        body = body.when(F.col("kind") == "object", F.concat(F.lit("{"), F.array_join(F.transform(
            "_children", lambda c: F.concat(_quoted(c["key"]), F.lit(":"), c["text"])), ","), F.lit("}")))
        text = F.when(F.col("_own") == 1, body.otherwise(F.col("value"))).otherwise(F.raise_error(F.concat(
            F.lit("node without a row of its own or with several: "), F.coalesce(F.col("_d").cast("string"), F.lit("null")),
            F.lit(" "), F.col("path"))))
        up = met.select(F.col("_d").alias("_doc"), "path", "parent", "pos", "key", text.cast("string").alias("text"))
    return up.select(F.col("_doc").alias(doc_id), "text", F.expr("try_parse_json(text)").alias("v"))
