"""Write-back: key checks, keyed merges, batch planning, payloads and outcomes.

Merges are joins on the key (both sides shuffled on it, or the smaller side
broadcast when AQE measures it small). Batch planning gives every record a
dense global index without a single-partition window: the input is range
partitioned and checkpointed, each partition numbers its rows locally, and a
table of per-partition offsets (one row per partition, so its size is bounded
by the partition count) is broadcast back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from weft.functions.scalar import key_text
from weft.operators.frames import group_collect
from weft.session import cut_lineage


# The default records per batch, and the markers of a multipart
# batch response (part separator, status line).
BATCH_SIZE = 1000
PART_SEPARATOR = "Content-ID:"
STATUS_LINE = r"HTTP/1\.1\s+(\d+)"


class KeyError_(ValueError):
    pass


# ---------------------------------------------------------------- keys

def resolve_columns(df: DataFrame, names) -> list[str]:
    """Map requested names onto ``df``'s columns case-insensitively (once)."""
    lower = {c.lower(): c for c in df.columns}
    out, missing = [], []
    for n in names:
        (out.append(lower[n.lower()]) if n.lower() in lower else missing.append(n))
    if missing:
        raise KeyError_(f"key column(s) {missing} not in source columns {df.columns}")
    return out


def resolve_key(meta: dict, key: str | None = None) -> list[str]:
    """Pick the key: explicit primary key, a single alternate key, or a multi-column
    alternate key given as a comma list in any order. ``meta`` has
    ``primary`` and ``alternate_keys`` (``[{"name", "columns"}]``)."""
    primary = meta.get("primary")
    alts = meta.get("alternate_keys", [])
    if key is None:
        return [primary]
    wanted = [k.strip().lower() for k in key.split(",") if k.strip()]
    if len(wanted) == 1 and primary and wanted[0] == primary.lower():
        return [primary]
    for alt in alts:
        cols = alt["columns"]
        if sorted(c.lower() for c in cols) == sorted(wanted) or alt["name"].lower() == ",".join(wanted):
            return list(cols)
    choices = [primary] + [",".join(a["columns"]) for a in alts]
    raise KeyError_(f"key {key!r} is neither the primary key nor an alternate key; use one of {choices}")


def key_violations(df: DataFrame, keys) -> DataFrame:
    """One row: total rows, rows with a null key part, keys occurring more than once."""
    keys = resolve_columns(df, keys)
    any_null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 \
        else F.col(keys[0]).isNull().cast("int")
    per_key = (df.select(*keys, any_null.alias("_null")).groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("_n"), F.max("_null").alias("_null")))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum(F.when(F.col("_null") == 1, F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.count_if((F.col("_n") > 1) & (F.col("_null") == 0)).alias("duplicate_keys"))


def fill_keys(df: DataFrame, key: str, natural) -> DataFrame:
    """Give rows without a key a deterministic id from their natural columns
    (recomputing a partition yields the same ids, unlike random UUIDs)."""
    return df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.md5(key_text(*natural))))


# ---------------------------------------------------------------- merges

def one_per_key(source: DataFrame, keys, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest source row per key by ``order``; without an order the source as it is, and a frame without
    rows of its shape that fails when it runs if a key occurs twice (the keys alone, sorted and counted run by run:
    a hash table of all keys takes more memory)."""
    keys = list(keys)
    if order is not None:
        return dedupe_latest(source, keys, order).select(*source.columns), source.limit(0)
    # Keys alone are so small that adaptive execution would put millions of them into one task.
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = source.select(*keys).repartition(n, *keys).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    said = F.raise_error(F.concat(F.lit(f"source key {','.join(keys)} occurs more than once: "), key_text(*keys)))
    twice = F.when(F.col("_n") > 1, said.cast("string"))  # one expression, so that only such keys reach the error
    none = [F.col(c) if c in keys else F.lit(None).cast(source.schema[c].dataType).alias(c) for c in source.columns]
    return source, counts.where(twice.isNotNull()).select(*none)


def upsert(target: DataFrame, source: DataFrame, keys, partial: bool = False, order: str | None = None) -> DataFrame:
    """Matched keys take the source row, unmatched source rows are inserted. A key that the source has twice
    fails, unless ``order`` names the column whose greatest value wins.

    ``partial=True``: the source may carry only some columns; those overwrite
    the target's where the source value is present (full outer join + coalesce).
    """
    keys = resolve_columns(source, keys)
    source, failing = one_per_key(source, keys, order)
    if not partial:
        kept = target.join(source.select(*keys), keys, "left_anti")
        return kept.unionByName(source.select(*target.columns)).unionByName(failing.select(*target.columns))
    source = source.unionByName(failing)
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys])
    j = target.join(s, keys, "full")
    cols = [F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) if c in source.columns and c not in keys
            else F.col(c) for c in target.columns]
    return j.select(*cols)


def insert(target: DataFrame, source: DataFrame, keys, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert-only: returns (new target, rejected source rows whose key exists). Repeated source keys as in
    :func:`upsert`."""
    keys = resolve_columns(source, keys)
    source, failing = one_per_key(source, keys, order)
    source = source.unionByName(failing)
    fresh = source.join(target.select(*keys), keys, "left_anti")
    rejected = source.join(target.select(*keys), keys, "left_semi")
    return target.unionByName(fresh.select(*target.columns)), rejected


def update(target: DataFrame, source: DataFrame, keys, order: str | None = None) -> DataFrame:
    """Update-only: matched rows take the source's non-key values; others unchanged. Repeated source keys as in
    :func:`upsert`."""
    keys = resolve_columns(source, keys)
    source, failing = one_per_key(source, keys, order)
    source = source.unionByName(failing)
    body = [c for c in source.columns if c not in keys]
    s = source.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_s_{c}") for c in body])
    j = target.join(s, keys, "left")
    cols = [F.when(F.col("_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in body
            else F.col(c) for c in target.columns]
    return j.select(*cols)


def delete(target: DataFrame, source: DataFrame, keys) -> DataFrame:
    keys = resolve_columns(source, keys)
    return target.join(source.select(*keys), keys, "left_anti")


def dedupe_latest(df: DataFrame, keys, order) -> DataFrame:
    """Keep the newest row per key (``max_by`` on the ordering, no sort of the whole table)."""
    body = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*body), F.col(order)).alias("_r"))
    return agg.select(*keys, "_r.*")


# ---------------------------------------------------------------- batches

def batch_plan(df: DataFrame, order=None, batch_size: int = BATCH_SIZE, num_partitions: int | None = None) -> DataFrame:
    """Adds ``_idx`` (dense 0-based global index in ``order``), ``_batch`` and
    ``_batch_pos``. Without ``order`` the existing partition order is used."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if order:
        order = [order] if isinstance(order, (str, Column)) else list(order)
        df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fixed = cut_lineage(df.withColumn("_pid", F.spark_partition_id())
                        .withColumn("_mid", F.monotonically_increasing_id()))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    counts = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window and the broadcast are bounded by the partition count
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    idx = (F.col("_off") + local).cast("bigint")
    return (fixed.join(F.broadcast(offsets), "_pid")
            .withColumn("_idx", idx)
            .withColumn("_batch", F.floor(F.col("_idx") / batch_size).cast("bigint"))
            .withColumn("_batch_pos", (F.col("_idx") % batch_size).cast("int"))
            .drop("_pid", "_mid", "_off"))


def batch_payloads(plan: DataFrame, columns, batch: str = "_batch", idx: str = "_idx") -> DataFrame:
    """One payload per batch: the records' JSON (nulls kept) joined by newlines in index order.
    A batch holds at most ``batch_size`` rows, so each group is bounded."""
    body = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    rows = plan.select(batch, idx, body.alias("_json"))
    return (group_collect(rows, batch, F.sort_array(F.collect_list(F.struct(F.col(idx), F.col("_json")))).alias("_r"),
                          F.min(idx).alias("first_idx"), F.count(F.lit(1)).alias("n_records"))
            .select(batch, "first_idx", "n_records",
                    F.array_join(F.transform("_r", lambda r: r["_json"]), "\n").alias("payload")))


def key_segment(df: DataFrame, keys, primary: bool = False) -> Column:
    """Address text of a record: the bare id for a primary key, else ``k='v',k2=3``
    with single quotes doubled inside string values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if primary and len(keys) == 1:
        return F.col(keys[0]).cast("string")
    parts = []
    for k in keys:
        v = F.col(k)
        if isinstance(types[k], NumericType):
            text = v.cast("string")
        else:
            text = F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        parts.append(F.concat(F.lit(f"{k}="), text))
    return F.concat_ws(",", *parts)


def batch_send(payloads: DataFrame, transport: Callable[[int, str], str], batch: str = "_batch") -> DataFrame:
    """Send each payload with ``transport(batch, payload) -> response text``.

    Runs in parallel over the payload partitions (``coalesce(n)`` before the
    call bounds concurrency). A retried task resends its batches, so targets
    must apply records idempotently by key.
    """
    import pandas as pd

    def send(batches):
        for pdf in batches:
            yield pd.DataFrame({batch: pdf[batch].astype("int64"),
                                "response": [transport(int(b), p) for b, p in zip(pdf[batch], pdf["payload"])]})

    return payloads.select(batch, "payload").mapInPandas(send, f"{batch} bigint, response string")


def batch_outcomes(responses: DataFrame, batch_size: int, batch: str = "_batch",
                   text: str = "response") -> DataFrame:
    """Per-record outcome from multipart batch responses: the text is split on
    ``Content-ID:``; each part gives the 1-based request id, the HTTP status and,
    for failures, ``error.message`` from its JSON body (else ``HTTP <status>``)."""
    parts = responses.select(batch, F.posexplode(F.split(F.col(text), PART_SEPARATOR)).alias("_p", "part"))
    parts = parts.where(F.col("_p") > 0)
    req = F.regexp_extract("part", r"^\s*(\d+)", 1)
    status = F.regexp_extract("part", STATUS_LINE, 1)
    body = F.regexp_extract("part", r"(\{[\s\S]*\})", 1)
    parts = (parts.withColumn("_req", F.when(req != "", req.cast("int")))
             .withColumn("status", F.when(status != "", status.cast("int")))
             .where(F.col("_req").isNotNull() & F.col("status").isNotNull()))
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    msg = F.coalesce(F.get_json_object(body, "$.error.message"),
                     F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return parts.select(
        F.col(batch), (F.col("_req") - 1).alias("_batch_pos"),
        (F.col(batch) * batch_size + F.col("_req") - 1).alias("_idx"),
        "status", ok.alias("ok"), F.when(~ok, msg).alias("message"))


def outcomes_with_records(outcomes: DataFrame, plan: DataFrame, keys) -> DataFrame:
    """Outcomes joined back to the planned source rows by global index."""
    key_text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    return (plan.select("_idx", *keys, key_text.alias("record_key"))
            .join(outcomes, "_idx", "left"))


def sync_summary(outcomes: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """total, succeeded, failed, skipped (planned records without an outcome)."""
    if plan is not None:
        o = plan.select("_idx").join(outcomes.select("_idx", "ok"), "_idx", "left")
    else:
        o = outcomes.select("ok")
    return o.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("ok")).alias("succeeded"),
                 F.count_if(~F.col("ok")).alias("failed"),
                 F.count_if(F.col("ok").isNull()).alias("skipped"))


def as_string_keys(df: DataFrame, keys) -> DataFrame:
    return df.select(*[F.col(c).cast(StringType()) if c in keys else F.col(c) for c in df.columns])
