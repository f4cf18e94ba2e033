"""One write-back call with a ledger, so that a rerun sends only what is still open.

``sync`` sends the records of a source to a keyed target in batches and appends an outcome per record to a
ledger: run, batch, record key, hash of the payload, operation, whether it succeeded and why not. Records
whose key and payload the ledger already has as delivered are subtracted first. The target's new
version is committed before the ledger's rows; a run that dies in between sends its records again,
which changes nothing, as they are applied by key and an insert of an equal row counts as delivered.

Per record, in this order: a null key fails; a key that occurs more than once in the source fails, unless
``order`` is given, which lets the newest row through and marks the others superseded; ``insert``
fails on a key the target has (with other values), ``update`` and ``delete`` on one it lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.scalar import key_text
from weft.operators import sync as merges
from weft.session import cut_lineage
from weft.tables import SavedTable

LEDGER = ("run int, _batch bigint, record_key string, payload_hash string, operation string, ok boolean, message string")
MODES = ("upsert", "insert", "update", "delete")


def open_ledger(spark, root: str) -> SavedTable:
    ledger = SavedTable(spark, root)
    if not ledger.versions():
        ledger.create(spark.createDataFrame([], LEDGER))
    return ledger


def sync(source: DataFrame, target: SavedTable, ledger: SavedTable, keys, mode: str = "upsert",
         batch_size: int = merges.BATCH_SIZE, order: str | None = None) -> DataFrame:
    """Outcomes of this run (the rows added to the ledger)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    keys = merges.resolve_columns(source, keys)
    columns = [f["name"] for f in target.manifest()["fields"]]
    past = ledger.read()
    run = (past.agg(F.max("run")).first()[0] or 0) + 1
    operation = "delete" if mode == "delete" else "write"
    rows = source.withColumn("record_key", key_text(*keys)).withColumn(
        "payload_hash", F.md5(key_text(*[c for c in columns if c in source.columns])))
    done = past.where(F.col("ok") & (F.col("operation") == operation)).select("record_key", "payload_hash").distinct()
    rows = rows.join(done, ["record_key", "payload_hash"], "left_anti")

    newest = F.struct(F.col(order) if order else F.lit(0), "payload_hash")
    per_key = rows.groupBy("record_key").agg(F.count("*").alias("_n"), F.max(newest).alias("_newest"))
    null_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    plan = merges.batch_plan(rows.join(per_key, "record_key"), "record_key", batch_size)
    there = target.read()
    held = there.withColumn("_there", F.lit(True)).select("_there", F.struct(*columns).alias("_old"),
                                                          key_text(*keys).alias("record_key"))
    met = plan.withColumn("_new", F.struct(*[c for c in columns if c in source.columns])).join(held, "record_key", "left")
    equal = F.lit(True)
    for c in columns:
        if c in source.columns:
            equal = equal & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    several = F.col("_n") > 1
    message = F.when(null_key, "key is null")
    if order is None:
        message = message.when(several, F.concat(F.lit("key occurs "), F.col("_n").cast("string"), F.lit(" times in the source")))
    else:
        message = message.when(several & (newest != F.col("_newest")), "superseded by a newer record")
    if mode == "insert":
        message = message.when(F.col("_there") & ~equal, "key exists in the target")
    elif mode in ("update", "delete"):
        message = message.when(F.col("_there").isNull(), "key is not in the target")
    outcomes = met.withColumn("message", message).withColumn("ok", F.col("message").isNull())
    # Of several equal rows with the newest order value, one is applied.
    outcomes = cut_lineage(outcomes.drop("_there", "_old", "_n", "_newest"))
    if outcomes.isEmpty():
        return outcomes.select(F.lit(run).alias("run"), "_batch", "record_key", "payload_hash",
                               F.lit(operation).alias("operation"), "ok", "message")
    n = int(target.spark.conf.get("spark.sql.shuffle.partitions"))  # not fewer: where only the keys are read they are small
    good = outcomes.where("ok").select("_new.*").repartition(n, *keys).dropDuplicates(keys)
    if mode == "delete":
        target.overwrite(merges.delete(there, good, keys))
    else:
        target.overwrite(merges.upsert(there, good, keys, partial=set(good.columns) != set(columns)))
    rows = outcomes.select(F.lit(run).alias("run"), "_batch", "record_key", "payload_hash",
                           F.lit(operation).alias("operation"), "ok", "message")
    ledger.insert(rows)
    return rows
