"""Join on overlapping ranges alone, without an equality key.

Both sides are cut into bins of one width (about the usual length of the intervals, from one small
aggregate), a row is copied to every bin it touches, and bins are joined by number, so Spark plans an
equality join and no nested loop. A pair meets in each bin both touch and is reported in the first of
them only. A bin with more than ``bin_rows`` left rows is split into lots: its left rows are
dealt out, its right rows copied to each lot, so a bin that holds a third of all rows is no hot task.

Bounds are numbers, dates or timestamps and belong to their interval. Rows with a null bound or an end
before the start overlap nothing; repeated rows each give their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from weft.session import cut_lineage

BIN_ROWS = 1 << 16


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def bin_width(*sides: tuple[DataFrame, tuple[str, str]]) -> float:
    """Twice the greater of the sides' median interval lengths; the span of the values if all are points."""
    width, low, high = 0.0, None, None
    for df, (start, end) in sides:
        size = _number(df, end) - _number(df, start)
        row = df.where(size >= 0).agg(F.percentile_approx(size, 0.5, 1000), F.min(_number(df, start)), F.max(_number(df, end)),
                                      F.count("*")).first()
        width = max(width, 2 * (row[0] or 0.0))
        if row[3]:
            low = row[1] if low is None else min(low, row[1])
            high = row[2] if high is None else max(high, row[2])
    return width or ((high - low) / 1024 if low is not None and high > low else 1.0)


def join_intervals(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str],
                   width: float | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Columns of both sides (names must differ) for every two rows whose ranges overlap. ``width`` is in the
    bounds' unit, microseconds for dates and timestamps; by default it is taken from the data."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; rename them first")
    width = width or bin_width((left, left_range), (right, right_range))

    def binned(df: DataFrame, bounds: tuple[str, str], side: str) -> DataFrame:
        low, high = (F.floor(_number(df, b) / width).cast("long") for b in bounds)
        rows = df.where(_number(df, bounds[1]) >= _number(df, bounds[0]))
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), low.alias(f"{side}_first"),
                           _number(df, bounds[0]).alias(f"{side}_a"), _number(df, bounds[1]).alias(f"{side}_z"),
                           F.explode(F.sequence(low, high)).alias("_bin"))
        return rows

    a, b = binned(left, left_range, "_l"), binned(right, right_range, "_r")
    # At most one row per bin_rows rows of the binned left side.
    full = cut_lineage(a.groupBy("_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > bin_rows).select(
        "_bin", F.ceil(F.col("_n") / bin_rows).cast("int").alias("_lots")))
    if full.isEmpty():
        a, b = a.withColumn("_lot", F.lit(0)), b.withColumn("_lot", F.lit(0))
    else:  # numbered rows are written once: a repeated task must deal its rows out as before
        a = cut_lineage(a.withColumn("_id", F.monotonically_increasing_id()))
        lots = F.coalesce(F.col("_lots"), F.lit(1))
        a = a.join(full, "_bin", "left").withColumn("_lot", F.pmod(F.xxhash64("_id"), lots).cast("int")).drop("_lots")
        b = b.join(full, "_bin", "left").withColumn("_lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("_lots")
    meet = (F.col("_l_a") <= F.col("_r_z")) & (F.col("_r_a") <= F.col("_l_z"))
    first = F.col("_bin") == F.greatest("_l_first", "_r_first")
    return a.join(b, ["_bin", "_lot"]).where(meet & first).select("_l.*", "_r.*")
