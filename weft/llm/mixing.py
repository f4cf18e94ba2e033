"""Mixing sources to target weights with Sainte-Laguë quotas, in DataFrame operations only.

1. Targets. The sources share all words by weight. A target stops at
   ``max_repeat`` times its source's size and the excess is shared again among
   the others by weight (water filling, in closed form over the source table).
2. Quotas. The words are cut into equal blocks. Sainte-Laguë gives the blocks
   to the sources by highest quotients ``target / (2k - 1)``; a second pass with
   the shard sizes as weights splits each source's blocks over its shards, so
   every (source, shard) has a whole number of blocks.
3. Selection. In each shard the documents lie on a line in seeded order. A
   quota takes the whole line as often as it fits and then its first blocks;
   a block border inside a document takes a part of it.

The number of shards of a source follows its size (``shard_words`` each), so a
source with a third of all rows is spread over many window groups. A shard's
rows depend on the seed and the document alone, so reruns agree.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source of its own, last in order; null ids and repeated rows are
separate rows with equal hashes, and which of two equal rows lies first does
not change the result set; an empty table gives an empty table. Other columns
pass through :func:`mix` and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.registry import query
from weft.llm.text import WORD
from weft.session import cut_lineage, spread_rows
from weft.sources.files import read_table

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
MAX_REPEAT = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) → plus ``weight`` and ``target``. One row per source: the
    windows over all rows see only this table."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    cap = F.lit(max_repeat) * F.col("source_size")
    # Sources reach their cap in the order of cap / weight. With the first i of
    # them at their caps, the others share the rest at `level` words per weight.
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    t = (t.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(so_far), F.lit(0)))
         .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
         .withColumn("_level", F.col("_left").cast("double") / F.col("_weights"))
         .withColumn("_free", F.when(F.col("_level") * F.col("weight") <= cap, F.row_number().over(by_cap))))
    # The first source whose share at its own level is within its cap sets the level for it and all after it.
    t = t.withColumn("_level", F.min_by("_level", "_free").over(whole))
    target = F.least(cap.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), cap.cast("double")))
    return t.withColumn("target", target).drop("_left", "_weights", "_level", "_free")


def sainte_lague(units: DataFrame, group: list[str], unit: list[str], weight: str, seats: str,
                 most: Column | None = None) -> DataFrame:
    """Give each group's ``seats`` (equal on its rows) to its units by the highest
    quotients ``weight / (2k - 1)``; adds ``quota``. ``most`` bounds a unit's quota.

    Rounding ``weight * seats / sum(weights)`` is within half a seat per unit of
    some Sainte-Laguë divisor, so only the quotients next to that rounding are
    listed and ranked: as many per unit as the roundings miss the seats by.
    """
    g = Window.partitionBy(*group)
    share = F.try_divide(F.col(weight) * F.col(seats), F.sum(weight).over(g))
    t = units.withColumn("_near", F.coalesce(F.round(share), F.lit(0)).cast("long"))
    t = t.withColumn("_off", F.abs(F.col(seats) - F.sum("_near").over(g)) + 1)
    t = t.withColumn("_sure", F.greatest(F.col("_near") - F.col("_off"), F.lit(0)))
    t = t.withColumn("_open", F.col(seats) - F.sum("_sure").over(g))
    listed = (t.withColumn("_k", F.explode(F.expr("sequence(_sure + 1, _near + _off + 1)")))
              .withColumn("_q", F.col(weight) / (2 * F.col("_k") - 1)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(
        F.col("_q").desc(), *[F.col(c).asc_nulls_last() for c in unit]))
    won = listed.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*unit).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in unit], "_won")
    same = [t[c].eqNullSafe(won[f"_w_{c}"]) for c in unit]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    quota = F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))
    if most is not None:
        quota = F.least(quota, most)
    return (t.join(won, cond, "left").withColumn("quota", quota)
            .drop("_near", "_off", "_sure", "_open", "_won", *[f"_w_{c}" for c in unit]))


def plan_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
             max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken`` (words the mix takes)."""
    text = F.col("text").cast("string")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = spread_rows(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("_key"))
    rows = cut_lineage(rows)  # the texts are counted once; what follows reads only these narrow rows

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, max_repeat)
    total = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    targets = sainte_lague(targets.withColumn("_seats", total).withColumn("_all", F.lit(0)), ["_all"], ["source"],
                           "target", "_seats")
    targets = (targets.withColumnRenamed("quota", "_blocks")
               .withColumn("_shards", F.ceil((F.col("source_size") + 1) / shard_words).cast("long"))
               .select(F.col("source").alias("_source"), "source_size", "target", "_blocks", "_shards"))
    targets = cut_lineage(targets)

    shard = F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.col("_shards"))
    placed = (rows.join(targets, rows["source"].eqNullSafe(targets["_source"]))
              .withColumn("_shard", shard))
    shards = (placed.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"),
                                                     F.first("_blocks").alias("_seats")))
    most = F.floor(F.lit(max_repeat) * F.col("_shard_size") / block_words).cast("long")
    shards = sainte_lague(shards, ["source"], ["source", "_shard"], "_shard_size", "_seats", most)
    shards = shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_shard_size",
                           (F.col("quota") * block_words).alias("_take"))
    line = Window.partitionBy("source", "_shard").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size")
    before = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    passes = F.when(F.col("_shard_size") > 0, F.floor(F.col("_take") / F.col("_shard_size"))).otherwise(0)
    rest = F.col("_take") - passes * F.col("_shard_size")
    taken = passes * F.col("size") + F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0))
    return (placed.withColumn("_before", before)
            .join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce(taken, F.lit(0)).cast("long").alias("taken")))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mix's plan per document, without the ``source`` column: one row per input row."""
    return plan_mix(docs, **params).drop("source")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {MAX_REPEAT} * source_size AS cap FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(
      (SELECT arg_min(level, place) FROM f WHERE level * weight <= cap) * weight, cap)) AS target,
    CAST((source_size + 1 + {SHARD_WORDS} - 1) // {SHARD_WORDS} AS BIGINT) AS shards
  FROM f
), q AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST) AS place
  FROM t, (SELECT unnest(range(1, CAST((SELECT sum(target) FROM t) / {BLOCK_WORDS} AS BIGINT) + 1)) AS k)
), b AS (
  SELECT source, count(*) AS blocks FROM q
  WHERE place <= (SELECT floor(sum(target) / {BLOCK_WORDS}) FROM t) GROUP BY source
), p AS (
  SELECT d.*, t.source_size, t.target, CAST('0x' || substr(k, 1, 8) AS BIGINT) % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM p GROUP BY source, shard
), r AS (
  SELECT u.source, u.shard, row_number() OVER (
      PARTITION BY u.source ORDER BY shard_size / (2 * k - 1) DESC, u.shard) AS place, b.blocks
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source, LATERAL (SELECT unnest(range(1, b.blocks + 1)) AS k)
), g AS (
  SELECT u.source, u.shard, shard_size, {BLOCK_WORDS} * least(coalesce(n, 0), {MAX_REPEAT} * shard_size // {BLOCK_WORDS}) AS take
  FROM u LEFT JOIN (SELECT source, shard, count(*) AS n FROM r WHERE place <= blocks GROUP BY source, shard) AS won
    ON u.source IS NOT DISTINCT FROM won.source AND u.shard = won.shard
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size = 0 THEN 0 ELSE take // shard_size * size
    + greatest(least(take - take // shard_size * shard_size - before, size), 0) END AS BIGINT) AS taken
FROM (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY k, doc_id NULLS LAST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM p) AS p
JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.shard = g.shard
"""


@query("op10_mixing", ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
