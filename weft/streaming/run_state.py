"""Stateful runs: events become runs per key, and a run is closed when no event came for a while.

``transformWithState`` keeps the open runs in RocksDB, not the events. An event joins the
run it is within the timeout of and may merge two; a timer closes a run once the watermark has passed its last
event by the timeout. As rows behind the watermark are dropped, no later row can belong to a closed
run, so the runs are the same for any order of the rows within the delay and any cut into batches.

Keys share state in ``BUCKETS`` buckets of their hash: a bucket's runs are merged together, as arrays, and it has
one timer, at its earliest run's end. State per key would cost a call into the JVM for each key, run and timer.
A bucket's rows are streamed to the processor, so a key with very many events is no large group; its open runs are
held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weft.streaming import streams

_STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_RUN = "started timestamp, ended timestamp, n_events long, last_order long, last_status string"
_FIELDS = ["started", "ended", "n_events", "last_order", "last_status"]
BUCKETS = 1024  # buckets of keys that share state: fixed for the life of a checkpoint
_BLOCK = 4096   # runs that are one element of a bucket's list


class RunProcessor(StatefulProcessor):
    """Open runs of a bucket of keys: frames ``[key, started, ended, n_events, last_order, last_status]``, times in us."""

    def __init__(self, key: str, kind: str, ts: str, order: str, status: str, timeout_us: int):
        self.key, self.kind, self.ts, self.order, self.status, self.timeout = key, kind, ts, order, status, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"key array<{self.kind}>, started array<long>, ended array<long>, "
                                                "n_events array<long>, last_order array<long>, last_status array<string>")

    def _load(self):
        """The bucket's open runs, a frame per block."""
        import pandas as pd

        return [pd.DataFrame({name: pd.Series(list(values), dtype=None if name in ("key", "last_status") else "int64")
                              for name, values in zip(["key", *_FIELDS], block)}) for block in self.open.get()]

    def _save(self, runs) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if runs is not None and len(runs):
            self.handle.registerTimer((int(runs["ended"].min()) + self.timeout) // 1000 + 1)
            self.open.put([tuple(runs[c].iloc[k:k + _BLOCK].tolist() for c in ["key", *_FIELDS])
                           for k in range(0, len(runs), _BLOCK)])
        elif self.open.exists():
            self.open.clear()

    def _merged(self, pieces):
        """Runs and events of the pieces as runs: of a key, what starts within the timeout of all before it joins them."""
        import numpy as np
        import pandas as pd

        runs = pd.concat(pieces, ignore_index=True).sort_values(["key", "started"], kind="stable", ignore_index=True)
        seen = runs.groupby("key", sort=False)["ended"].cummax().to_numpy()
        new = np.append(True, (runs["key"].to_numpy()[1:] != runs["key"].to_numpy()[:-1])
                        | (runs["started"].to_numpy()[1:] - seen[:-1] >= self.timeout))
        heads, run = np.flatnonzero(new), np.cumsum(new) - 1
        latest = np.lexsort((runs["last_order"], runs["ended"], run))[np.append(heads[1:], len(runs)) - 1]
        return pd.DataFrame({"key": runs["key"].to_numpy()[heads], "started": runs["started"].to_numpy()[heads],
                             "ended": runs["ended"].to_numpy()[latest],
                             "n_events": np.add.reduceat(runs["n_events"].to_numpy(), heads),
                             "last_order": runs["last_order"].to_numpy()[latest],
                             "last_status": runs["last_status"].to_numpy()[latest]})

    def _close(self, runs, mark: int):
        """Keep the runs still open at ``mark``; yield the others as rows."""
        import pandas as pd

        over = runs["ended"] + self.timeout <= mark
        self._save(runs[~over])
        if over.any():
            done = runs[over].rename(columns={"key": self.key})
            for c in ("started", "ended"):
                done[c] = pd.to_datetime(done[c], unit="us")
            yield done

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held, fresh = self._load(), []
        for frame in rows:
            at = frame[self.ts].astype("datetime64[us]").astype("int64")
            fresh.append(pd.DataFrame({"key": frame[self.key], "started": at, "ended": at, "n_events": 1,
                                       "last_order": frame[self.order].astype("int64"), "last_status": frame[self.status]}))
            if sum(map(len, fresh)) > max(sum(map(len, held)), 1 << 16):  # merged when the runs held have doubled
                held, fresh = [self._merged(held + fresh)], []
        # All rows of the batch are in, and later ones behind this mark are dropped.
        yield from self._close(self._merged(held + fresh), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held = self._load()
        if held:
            yield from self._close(self._merged(held), timerValues.getCurrentWatermarkInMs() * 1000)


def close_runs(events: DataFrame, key: str, ts: str, order: str, status: str, out: str, checkpoint: str,
               timeout: str, delay: str) -> None:
    """Append runs of ``key`` closed by ``timeout`` to ``out``: ``key, started, ended, n_events, last_order,
    last_status``. ``order`` (a number) breaks ties in time; rows without a key or time are dropped."""
    spark = events.sparkSession
    gap = spark.sql(f"select (timestamp '2000-01-01' + interval {timeout}) - timestamp '2000-01-01' as d").first()[0]
    timeout_us = int(gap.total_seconds() * 1_000_000)
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    kind = events.schema[key].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    runs = rows.select(bucket, key, ts, order, status).groupBy("_bucket").transformWithStateInPandas(
        RunProcessor(key, kind, ts, order, status, timeout_us), f"{key} {kind}, {_RUN}", "Append", "EventTime")
    before = {name: spark.conf.get(name, None) for name in _STATE_CONF}
    for name, value in _STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        streams.run_to_parquet(runs, out, checkpoint)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_runs(spark: SparkSession, out: str, checkpoint: str, key: str) -> DataFrame:
    """All runs: the closed ones and, from the stream's state, those still open (column ``state``)."""
    closed = spark.read.parquet(out).withColumn("state", F.lit("closed"))
    state = (spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true")
             .load(checkpoint))
    block = F.col("list_element")
    runs = state.select(F.explode(F.arrays_zip(*[block[c].alias(c) for c in ["key", *_FIELDS]])).alias("run")).select("run.*")
    still = runs.select(F.col("key").alias(key), F.timestamp_micros("started").alias("started"),
                        F.timestamp_micros("ended").alias("ended"), "n_events", "last_order", "last_status",
                        F.lit("open").alias("state"))
    return closed.unionByName(still)
