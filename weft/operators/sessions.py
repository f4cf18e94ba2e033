"""Sessions by a table-argument UDTF: rows of a key, in time order, streamed through a small state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StructType, TimestampNTZType

NAME = "weft_sessions"


@udtf
class Sessions:
    """``weft_sessions(table, key, ts, gap seconds)``: one row per session: key, started, ended, n.

    ``analyze`` asks Spark to partition by the key and sort by time itself. A row is seen once and only the
    open session is held, so a hot key is streamed. A null time belongs to no session; rows without a key are one key."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, ts: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        for arg in (key, ts, gap):
            if not arg.isConstantExpression:
                raise ValueError("key, ts and gap must be constants")
        kind = rows.dataType[key.value].dataType
        schema = (StructType().add(key.value, kind).add("started", TimestampNTZType()).add("ended", TimestampNTZType())
                  .add("n", LongType()))
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(ts.value)])

    def __init__(self):
        self.open = None

    def eval(self, row, key, ts, gap):
        at = row[ts]
        if at is None:
            return
        if self.open is not None and (at - self.open[2]).total_seconds() < gap:
            self.open[2], self.open[3] = at, self.open[3] + 1
            return
        done, self.open = self.open, [row[key], at, at, 1]
        if done is not None:
            yield tuple(done)

    def terminate(self):
        if self.open is not None:
            yield tuple(self.open)


def register(spark: SparkSession) -> str:
    spark.udtf.register(NAME, Sessions)
    return NAME
