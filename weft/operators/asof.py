"""As-of join: for each left row, the latest right row with the same key at or
before its time (``left.ts >= right.ts``), or nulls when there is none.

Spark SQL has no as-of join. The union-and-window recipe (``last(…, ignorenulls)
over (partition by key order by ts)``) puts every row of a key into one window
partition, so a key that owns a third of the data would be one task. Here the
window is partitioned by (key, time bucket) instead, and the value carried into
a bucket from earlier buckets comes from a small table with one row per
(key, bucket) that occurs in the data:

1. ``last_in_bucket``: the latest right row per (key, bucket) – a partial
   aggregate (``max_by``), so hot keys are pre-aggregated map-side;
2. ``carry``: for every (key, bucket) seen on either side, the latest right row
   of any *earlier* bucket – a running ``last`` over that small table;
3. the main window over (key, bucket) takes the latest right row so far in the
   bucket and falls back to the carried one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_asof(left: DataFrame, right: DataFrame, by, ts: str, right_ts: str | None = None,
              bucket_seconds: int = 86400, right_prefix: str = "", tie: str | None = None) -> DataFrame:
    """Left rows with the columns of their as-of right row (``right_prefix`` + name). Of right rows with equal times
    the one with the greatest ``tie`` column is taken; without one, with the greatest other columns in their order
    (as JSON text)."""
    by = [by] if isinstance(by, str) else list(by)
    right_ts = right_ts or ts
    r_cols = [c for c in right.columns if c not in by]
    out_names = {c: f"{right_prefix}{c}" for c in r_cols}
    clash = set(out_names.values()) & set(left.columns)
    if clash:
        raise ValueError(f"right columns clash with left columns: {sorted(clash)}; pass right_prefix")

    def bucket(c):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000)).cast("bigint")

    r = right.select(*by, F.col(right_ts).alias("_ts"), bucket(right_ts).alias("_b"),
                     F.struct(*[F.col(c).alias(out_names[c]) for c in r_cols]).alias("_r"),
                     (F.col(tie) if tie else F.to_json(F.struct(*[F.col(c) for c in r_cols]))).alias("_tie"))
    lt = left.select(*by, F.col(ts).alias("_ts"), bucket(ts).alias("_b"),
                     F.struct(*[F.col(c) for c in left.columns]).alias("_l"))

    # 1. latest right row per (key, bucket)
    last_in_bucket = r.groupBy(*by, "_b").agg(F.max_by("_r", F.struct("_ts", "_tie")).alias("_last"))
    # 2. carried value for every (key, bucket) present on either side
    seen = lt.select(*by, "_b").union(r.select(*by, "_b")).distinct()
    wk = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (seen.join(last_in_bucket, [*by, "_b"], "left")
             .select(*by, "_b", F.last("_last", ignorenulls=True).over(wk).alias("_carry")))
    # 3. running latest right row inside each (key, bucket); right sorts before left at equal times
    both = (lt.select(*by, "_ts", "_b", F.lit(1).alias("_side"), "_l", F.lit(None).cast(r.schema["_r"].dataType)
                      .alias("_r"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"))
            .unionByName(r.select(*by, "_ts", "_b", F.lit(0).alias("_side"),
                                  F.lit(None).cast(lt.schema["_l"].dataType).alias("_l"), "_r", "_tie")))
    wb = (Window.partitionBy(*by, "_b").orderBy("_ts", "_side", "_tie")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = (both.withColumn("_m", F.last("_r", ignorenulls=True).over(wb))
               .where(F.col("_side") == 1)
               .join(carry, [*by, "_b"], "left")
               .withColumn("_m", F.coalesce("_m", "_carry")))
    return matched.select("_l.*", *[F.col("_m").getField(n).alias(n) for n in out_names.values()])
