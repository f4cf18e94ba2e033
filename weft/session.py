"""Spark session setup and the shared checkpoint folder.

All library code takes a session from the caller; this module only builds one
for tests, the bench and the driver hooks, and makes sure lineage can be cut
with a reliable ``checkpoint()`` in the folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every query in the library relies on: UTC so timestamps print the
# same as in the oracle, AQE for runtime coalescing and skew splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (about 1000 executors, inputs of 100 TB). Many
# initial shuffle partitions that AQE coalesces to the advisory size, so no
# reducer has to hold more than a few hundred MB; splits of 256 MB; skewed
# partitions split once they are 4x the median and above 512 MB; broadcasts
# only for sides Spark measures below 64 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "weft", extra: dict | None = None) -> SparkSession:
    """Session for local runs (tests, bench). On a cluster the caller brings its own."""
    cpus = os.environ.get("BENCH_CPUS")
    master = master or f"local[{cpus or '*'}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus or 8))
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Pin the runtime settings the oracle comparison depends on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; invent a local one only when unset (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    try:
        configured = configured or spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001 - unset key raises on some versions
        pass
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="weft-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss). With ``free_shuffles``
    the shuffle files of its own plan go as soon as that is done, as nothing reads them again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not free_shuffles:
        return df.checkpoint(eager=True)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(key, before)


def spread_rows(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over at least ``min_partitions`` (default: the cluster's
    cores) when it has fewer, so CPU-heavy per-row work is not left to one task.

    A large scan already has at least that many splits and is returned as is,
    so no shuffle is added at scale. Call it on a scan (plus row-local
    projections): counting the partitions of a plan that already shuffles makes
    adaptive execution run that shuffle first, and such a plan has the
    shuffle's partition count anyway."""
    if df.isStreaming:  # micro-batches are sized by the source's trigger options
        return df
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
