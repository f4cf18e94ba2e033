"""DataFrame steps: search, paging, pivot, conditional update, user steps, pandas helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.scalar import search_any_column


def search(df: DataFrame, term: str) -> DataFrame:
    """Rows where any column's text contains ``term`` (case-insensitive)."""
    return df.where(search_any_column(df, term))


def page(df: DataFrame, order_by, page_no: int, size: int) -> DataFrame:
    """Page ``page_no`` (0-based) of ``size`` rows in a total order (top-k + offset)."""
    cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return df.orderBy(*cols).offset(page_no * size).limit(size)


def pivot_mean(df: DataFrame, index, columns: str, values: str, column_values=None, digits: int = 2) -> DataFrame:
    """``pivot_table(values, index, columns, aggfunc=mean)``. Passing the column values
    avoids the extra job that finds them."""
    idx = [index] if isinstance(index, str) else list(index)
    g = df.groupBy(*idx).pivot(columns, column_values)
    out = g.agg(F.avg(values))
    return out.select(*idx, *[(F.round(F.col(c), digits) + 0.0).alias(c) for c in out.columns if c not in idx])


def conditional_update(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """``df.loc[cond, column] = value`` as one projection."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def python_step(tables: dict[str, DataFrame], step: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """A user step: a function of the named tables returning a DataFrame (lazy)."""
    out = step(dict(tables))
    if not isinstance(out, DataFrame):
        raise TypeError("a step must return a DataFrame")
    return out


def map_pandas(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Row-local pandas code over Arrow batches (``mapInPandas``)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def grouped_pandas_agg(df: DataFrame, keys, partial: Callable, partial_schema: str,
                       merge: dict[str, Column], finish: dict[str, Column]) -> DataFrame:
    """Per-group statistics written in pandas without materialising any group.

    ``partial(pdf)`` runs on each Arrow batch and returns per-key partial
    aggregates (``partial_schema``); Spark merges them with the ``merge``
    aggregates and computes the ``finish`` columns. A key holding a third of the
    data only contributes one partial row per batch, so no task or group grows
    with it.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield partial(pdf)

    parts = df.mapInPandas(run, partial_schema)
    merged = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
    return merged.select(*keys, *[c.alias(n) for n, c in finish.items()])


def grouped_udaf(df: DataFrame, keys, udaf, args, merge: Callable[[Column], Column], name: str) -> DataFrame:
    """A grouped-aggregate pandas UDF, run in two phases so no group is unbounded.

    Phase one applies ``udaf`` per key *and* input partition (a group never
    holds more than one scan split's rows, however hot the key); phase two
    merges the partials with a built-in aggregate (``merge``, e.g. ``F.sum``),
    which Spark combines map-side. The UDAF must be decomposable that way.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    split = df.withColumn("_split", F.spark_partition_id())
    partials = split.groupBy(*keys, "_split").agg(udaf(*args).alias("_partial"))
    return partials.groupBy(*keys).agg(merge(F.col("_partial")).alias(name))


def group_collect(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` for collecting aggregates (``collect_list`` and
    the like), hash-partitioned on the keys first.

    Collecting gains nothing from a map-side partial aggregate: it ships the
    same rows, only as lists, and builds them where the scan is (one task for an
    unsplittable file). Shuffling the rows and collecting once after the
    exchange does the work in parallel, in the same stage as the aggregate.
    """
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    return df.repartition(*keys).groupBy(*keys).agg(*aggs)
