"""Exact deduplication with keyed streaming state that never expires.

1. Fingerprints. A stream reads the table's files and appends, per row, its id, the SHA-256
   of its normalised text and its content locator (file and row number in the file).
2. Keyed state. A second stream groups the fingerprints by digest. Its state lives in RocksDB,
   on disk, without a watermark, so a digest is remembered for good: the state keeps the digest, the
   smallest id seen, the locator of that row's content and the number of rows. New files in the
   table's folder are added by running again on the same ``root``.
3. Bytes. Every row whose digest was hit more than once is fetched by its locator and compared with
   the retained content, byte for byte. Rows of a digest whose contents differ are grouped by
   their whole text instead.

Everything is streaming or batch DataFrame operations. Rows of one digest meet only as partial
aggregates (a state row and one text per task), so a group of a third of all rows is no hot
task. The rows of a digest that holds over a thousandth of all rows (so at most a thousand
digests) get their state by broadcast, all others by a shuffle on the digest.

Texts are equal when identical after replacing each run of space and \\t \\n \\v \\f \\r by one space.
Defined results: a null text counts as empty; of equal texts the smallest id stays, a null id comes
last, and of rows that tie (repeated ids) the one first in (file, row) order stays; an empty table
gives no rows. Other columns are not read, whatever their names, and pass through :func:`dedup`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.llm.registry import query
from weft.session import cut_lineage, ensure_checkpoint_dir
from weft.sources.files import stream_parquet, table_path

SPACE = "[\\x20\\x09-\\x0D]+"
HOT = 1000  # a digest with more than 1/HOT of the rows is hot
BATCH = {"maxBytesPerTrigger": str(1 << 38)}  # of files a micro-batch takes
# State on disk; a commit writes the changes only, and no store reserves disk that it does not use.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _same(digest: Column) -> Column:
    return digest


def _run(frame: DataFrame, sink: str, mode: str, checkpoint: str, **options) -> None:
    """Take all files there are, in micro-batches, and end."""
    (frame.writeStream.format(sink).outputMode(mode).options(checkpointLocation=checkpoint, **options)
     .trigger(availableNow=True).start().awaitTermination())


def fingerprints(spark: SparkSession, path: str, root: str, doc_id: str = "doc_id", text: str = "text",
                 **options) -> DataFrame:
    """Append the fingerprints of the table's new files to the log under ``root``; the whole log:
    ``doc_id, sha, file, row``."""
    table = spark.read.parquet(path).schema
    rows = stream_parquet(spark, path, StructType([table[doc_id], table[text]]), **(options or BATCH))
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("sha"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    _run(rows, "parquet", "append", f"{root}/fingerprints-progress", path=f"{root}/fingerprints")
    return spark.read.schema(rows.schema).parquet(f"{root}/fingerprints")


def keyed_state(spark: SparkSession, log: DataFrame, root: str, digest: Callable[[Column], Column] = _same,
                **options) -> DataFrame:
    """Bring the keyed state under ``root`` up to the log; the state: ``digest, first, size``, where
    ``first`` has the smallest id of the digest and the locator of its row."""
    rows = stream_parquet(spark, f"{root}/fingerprints", log.schema, **(options or BATCH))
    state = rows.groupBy(digest(F.col("sha")).alias("digest")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first"),
        F.count("*").alias("size"))
    before = {name: spark.conf.get(name, None) for name in _STATE_CONF}
    for name, value in _STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        _run(state, "noop", "update", f"{root}/state")
        found = spark.read.format("statestore").load(f"{root}/state")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    # The state names its columns after the plan: the key, then the buffers of min and count.
    (key,), (first, size) = (found.schema[c].dataType.fieldNames() for c in ("key", "value"))
    return found.select(F.col(f"key.`{key}`").alias("digest"), F.col(f"value.`{first}`").alias("first"),
                        F.col(f"value.`{size}`").alias("size"))


def _texts(spark: SparkSession, path: str, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the normalised text each of its locators names."""
    schema = StructType([spark.read.parquet(path).schema[text]])
    content = spark.read.schema(schema).parquet(path).select(
        F.col(text).alias("_text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return wanted.join(content, ["file", "row"]).withColumn("_text", normalised(F.col("_text")))


def groups(spark: SparkSession, path: str, root: str | None = None, doc_id: str = "doc_id", text: str = "text",
           digest: Callable[[Column], Column] = _same, **options) -> DataFrame:
    """Per row of the Parquet table at ``path``: ``doc_id, sha, file, row, first, size``. ``first`` is the row
    that stays, ``size`` the number of rows with an equal text.

    ``root`` holds the streams' state in shared storage; runs with the same ``root`` go on from it."""
    root = root or f"{ensure_checkpoint_dir(spark)}/exact-{uuid.uuid4().hex}"
    log = fingerprints(spark, path, root, doc_id, text, **options)
    rows = log.withColumn("digest", digest(F.col("sha")))
    if log.isEmpty():
        first = F.struct(F.lit(True).alias("no_id"), "doc_id", "file", "row")
        return rows.select("doc_id", "sha", "file", "row", first.alias("first"), F.lit(1).cast("long").alias("size"))
    state = cut_lineage(keyed_state(spark, log, root, digest, **options))
    total = state.agg(F.sum("size")).first()[0]
    hot = F.col("size") * HOT > total
    marked = rows.join(F.broadcast(state.where(hot)), "digest", "left")
    seen = marked.where("size is not null").unionByName(
        marked.where("size is null").drop("first", "size").join(state.where(~hot), "digest"))

    hits = _texts(spark, path, text, seen.where("size > 1").select("digest", "file", "row"))
    differing = cut_lineage(hits.groupBy("digest").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
                            .where("low <> high").select("digest"))
    if not differing.isEmpty():  # one digest, several texts: those rows are told apart by their bytes
        apart = _texts(spark, path, text, seen.join(differing, "digest", "left_semi").drop("first", "size"))
        own = apart.groupBy(F.col("_text").alias("_own")).agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first"),
            F.count("*").alias("size"))
        seen = seen.join(differing, "digest", "left_anti").unionByName(
            apart.join(own, apart["_text"] == own["_own"]).drop("_text", "_own"))
    return seen.select("doc_id", "sha", "file", "row", "first", "size")


def _kept() -> Column:
    return (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))


def decisions(spark: SparkSession, path: str, root: str | None = None, **options) -> DataFrame:
    """Per row: ``doc_id, keep_id`` (id of the row that stays), ``group_size, kept, text_sha256``."""
    return groups(spark, path, root, **options).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), _kept().alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(spark: SparkSession, path: str, root: str | None = None, **options) -> DataFrame:
    """The table at ``path`` without the rows whose text an other row that stays holds; all columns."""
    gone = groups(spark, path, root, **options).where(~_kept()).select(
        F.col("file").alias("_gone_file"), F.col("row").alias("_gone_row"))
    table = spark.read.parquet(path)
    place = table.select("*", F.col("_metadata.file_path").alias("_at_file"), F.col("_metadata.row_index").alias("_at_row"))
    same = (F.col("_at_file") == F.col("_gone_file")) & (F.col("_at_row") == F.col("_gone_row"))
    return place.join(gone, same, "left_anti").select(*[table[c] for c in table.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


@query("op11_exact_dedup", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, table_path(sf_dir, "documents"))
