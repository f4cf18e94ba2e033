"""Mergeable summaries per day, and samples with a fixed result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Standard error of the distinct count: 1.04 / sqrt(2^LOG_K). Rank error of a quantile: about 2.3 / K^0.9.
LOG_K = 14
K = 1000
DISTINCT_ERROR = 4 * 1.04 / 2 ** (LOG_K / 2)   # four standard errors
RANK_ERROR = 0.01


def sketch_states(df: DataFrame, keys, distinct: str, value: str) -> DataFrame:
    """Per key: ``n``, an HLL state of ``distinct`` and a KLL state of the number ``value``. States are a few
    kilobytes whatever the size of the group, and are built map-side."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LOG_K)).alias("distinct_state"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("value_state"))


def merge_states(states: DataFrame, keys) -> DataFrame:
    """The states of coarser keys, from stored ones: any range of days without reading its rows."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_state").alias("distinct_state"),
                                     F.kll_merge_agg_double("value_state").alias("value_state"))


def distinct_estimate(state: str = "distinct_state") -> Column:
    return F.hll_sketch_estimate(state)


def quantile_estimate(q: float, state: str = "value_state") -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(q))


def sample_stratified(df: DataFrame, strata, ident, k: int, seed: str = "") -> DataFrame:
    """The ``k`` rows of each stratum with the smallest keyed hash of ``ident``, and ``weight``: the rows of the
    stratum each stands for. The result depends on the rows and the seed alone, not on how they
    are dealt out. Every task keeps ``k`` rows per stratum before any row moves; rows with equal
    hashes (a repeated ``ident``) go by their remaining columns."""
    strata, ident = [strata] if isinstance(strata, str) else list(strata), [ident] if isinstance(ident, str) else list(ident)
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ident]))
    ties = [F.col(c) for c in df.columns if c not in strata]
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest", *ties))
    picked = df.withColumn("_digest", digest).withColumn("_place", place).where(F.col("_place") <= k)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size")).select(
        *[F.col(c).alias(f"_s_{c}") for c in strata], "_size")
    same = F.lit(True)
    for c in strata:
        same = same & picked[c].eqNullSafe(sizes[f"_s_{c}"])
    return picked.join(sizes, same).withColumn("weight", F.col("_size") / F.least("_size", F.lit(k))).select(*df.columns, "weight")
