"""Structured Streaming versions of the operators.

Every stream reads files (a folder that files are dropped into), keeps its
checkpoint and output in the shared checkpoint folder, and writes through
``foreachBatch`` or the file sink, never the driver-side memory sink. Writes
are keyed or versioned by batch id so a replayed batch produces the same
result (exactly-once output on top of at-least-once execution). Keyed targets
are merged on read: a batch appends only its own rows, and a periodic
compaction writes a new base, so no micro-batch rewrites the whole target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.nested import shred
from weft.operators.validate import validate
from weft.sinks.files import scratch_dir


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``timestamp_ntz`` cannot carry a watermark: use a session-time (UTC) timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into Parquet files (file sink, append)."""
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_validate(requests: DataFrame, schema: dict, text: str, out: str, checkpoint: str) -> None:
    """Stateless: each micro-batch is checked with the same Column rules as a table."""
    run_to_parquet(validate(requests, schema, text=text), out, checkpoint)


def stream_latest_state(events: DataFrame, keys, status: str, order, out: str, checkpoint: str,
                        extra_max=()) -> None:
    """Current state per run: a streaming aggregate in update mode; each batch's
    changed keys are merged into the state table by key (replay-safe)."""
    keys = list(keys)
    agg = events.groupBy(*keys).agg(
        F.max_by(F.col(status), F.when(F.col(status).isNotNull(), F.struct(*order))).alias(status),
        F.max(order[0]).alias(order[0]), *[F.max(c).alias(c) for c in extra_max])

    def merge(batch: DataFrame, batch_id: int) -> None:
        _versioned_merge(batch, keys, out, batch_id)

    run_foreach_batch(agg, merge, checkpoint, mode="update")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _latest_base(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """Newest complete compacted base ``(path, first batch not in it)``; listing
    goes through the Hadoop file system, so it works on any shared storage."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return None
    names = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())
    done = [n for n in names if n.startswith("base-")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return (f"{root}/{done[-1]}", int(done[-1][len("base-"):])) if done else None


def _has_changes(spark: SparkSession, root: str) -> bool:
    fs, p, jvm = _fs(spark, f"{root}/changes")
    return fs.exists(p) and any(st.isDirectory() for st in fs.listStatus(p))


def seed_versioned(df: DataFrame, root: str, order: str | None = None) -> None:
    """The target before any batch: base 0. ``order``: the column that says how new a row is, if it has one."""
    if order is not None:
        df = df.withColumn("_order", F.col(order))
    df.write.mode("overwrite").parquet(f"{root}/base-{0:012d}")


def read_versioned(spark: SparkSession, root: str, keys) -> DataFrame:
    """Current table: the newest row per key over the latest base and the change
    batches after it (merge on read). Newest is by the stored order value, if the batches were merged
    with one, then by batch; a row without an order value is older than any with one. ``max_by`` is a
    partial aggregate, so a hot key is reduced map-side; batches already compacted into
    the base are pruned by their partition value."""
    rows = _newest(spark, root, list(keys))
    return rows.drop("_order")


def _newest(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    base = _latest_base(spark, root)
    parts = []
    first = 0
    if base is not None:
        path, first = base
        parts.append(spark.read.parquet(path).withColumn("_batch", F.lit(first - 1)))
    if _has_changes(spark, root):
        parts.append(spark.read.parquet(f"{root}/changes").where(F.col("_batch") >= first))
    if not parts:
        raise FileNotFoundError(f"no versioned table under {root}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    body = [c for c in rows.columns if c not in keys and c != "_batch"]
    age = F.struct(*[c for c in ("_order", "_batch") if c in rows.columns])
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*body), age).alias("_r"))
            .select(*keys, "_r.*"))


def _versioned_merge(batch: DataFrame, keys, root: str, batch_id: int, order: str | None = None,
                     compact_every: int = 10) -> None:
    """Upsert one micro-batch: append its newest row per key as change batch
    ``batch_id`` (a replay overwrites the same partition), so a batch costs its
    own size, not the target's. The ``order`` value is stored with each row, so a change that
    arrives in a later batch than a newer one does not win. Every ``compact_every`` batches the merged
    table is written as a new base that later reads start from."""
    spark = batch.sparkSession
    if order is not None:
        batch = batch.withColumn("_order", F.col(order))
        body = [c for c in batch.columns if c not in keys]
        batch = (batch.groupBy(*keys).agg(F.max_by(F.struct(*body), F.col(order)).alias("_r"))
                 .select(*keys, "_r.*"))
    base = _latest_base(spark, root)
    if base is not None:  # changes carry the target's columns
        columns = [c for c in spark.read.parquet(base[0]).columns if c != "_order"]
        batch = batch.select(*columns, *[c for c in ("_order",) if c in batch.columns])
    (batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{root}/changes"))
    if (batch_id + 1) % compact_every == 0:
        target = f"{root}/base-{batch_id + 1:012d}"
        if base is None or base[0] != target:
            _newest(spark, root, list(keys)).write.mode("overwrite").parquet(target)


def stream_shred(docs: DataFrame, name: str, key_cols, out: str, checkpoint: str) -> None:
    """Each dropped batch of nested documents is shredded into its linked tables,
    appended under ``out/<table>`` with the batch id as a partition (replay overwrites it)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # one write per table: keep the parsed batch instead of re-reading and
        # re-parsing its files for every table (a lost block is recomputed)
        batch.persist()
        try:
            for table, part in shred(batch, name, key_cols=key_cols).items():
                (part.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{out}/{table}"))
        finally:
            batch.unpersist()

    run_foreach_batch(docs, write, checkpoint)


def stream_upsert(changes: DataFrame, keys, order: str, out: str, checkpoint: str) -> None:
    """Write-back of a change stream: keep the newest change per key inside each
    batch, then upsert into the versioned target. The newest change by ``order`` wins,
    whatever the batches they arrive in."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        _versioned_merge(batch, list(keys), out, batch_id, order=order)

    run_foreach_batch(changes, merge, checkpoint)


def stream_windows(events: DataFrame, ts: str, keys, window: str, delay: str, out: str, checkpoint: str,
                   **sums: str) -> None:
    """Tumbling windows that lose no row. A row behind the watermark (newest ``ts`` of all earlier batches less
    ``delay``) is stored in ``out/late`` with its batch; all others are counted into ``out/windows``, a row
    per batch, window and key: ``n`` and the ``sums`` (name=column). Each batch writes its own partition and
    judges by the marks of earlier ones only, so a replayed batch gives the same files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            mark = None
            if batch_id and _fs(spark, f"{out}/marks")[0].exists(_fs(spark, f"{out}/marks")[1]):
                mark = spark.read.parquet(f"{out}/marks").where(F.col("_batch") < batch_id).agg(F.max("seen")).first()[0]
            late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark) - F.expr(f"interval {delay}"), F.lit(False))
            _batch_write(_window_counts(batch.where(~late), ts, keys, window, sums), f"{out}/windows", batch_id)
            _batch_write(batch.where(late), f"{out}/late", batch_id)
            _batch_write(batch.agg(F.max(ts).alias("seen")), f"{out}/marks", batch_id)
        finally:
            batch.unpersist()

    run_foreach_batch(events, write, checkpoint)


def _batch_write(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path))


def _window_counts(rows: DataFrame, ts: str, keys, window: str, sums: dict) -> DataFrame:
    return rows.groupBy(F.window(ts, window).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def corrected_windows(spark: SparkSession, out: str, schema, ts: str, keys, window: str, **sums: str) -> DataFrame:
    """The correction step of :func:`stream_windows`: late rows merged into their windows. Per window and key:
    ``n_on_time``, ``n_late`` and the sums over both. ``schema`` is that of the late rows."""
    counts = spark.read.parquet(f"{out}/windows").drop("_batch").withColumn("late", F.lit(False))
    late = spark.read.schema(schema).parquet(f"{out}/late")
    late = _window_counts(late, ts, keys, window, sums).withColumn("late", F.lit(True))
    return counts.unionByName(late).groupBy("window", *keys).agg(
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("n"))), F.lit(0)).alias("n_on_time"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("n_late"),
        *[F.sum(name).alias(name) for name in sums])


def scratch(spark: SparkSession, purpose: str) -> tuple[str, str]:
    base = scratch_dir(spark, purpose)
    return f"{base}/out", f"{base}/checkpoint"
