"""Connector for folders of Arrow IPC files, a format Spark has no reader or writer for.

Read side: one partition per record batch group of a file, the wanted columns only, and comparisons with constants
pushed down: they are checked against the minimum and maximum of each batch, which the writer stores in
the file's footer, so batches that cannot match are not read; the rows that are read are
still filtered by Spark. Write side: every task writes its own file under a hidden folder of
the job, the driver's commit moves the files into place, and an abort (or a task that failed and
was repeated) leaves nothing visible. Stream side: offsets are the commits of the folder in order, so a stream sees
whole commits only.

A commit is a small listing ``_commits/NNNNNNNN.json`` of the files it added; readers see the files of commits
only. Paths may be local or any URI pyarrow's file systems understand, and must be shared by the cluster.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

FORMAT = "weft_arrow"
COMMITS, STAGED = "_commits", "_staged"
# Comparison → whether values between low and high can meet it.
_CAN_MATCH = {
    EqualTo: lambda low, high, v: low <= v <= high,
    GreaterThan: lambda low, high, v: high > v, GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v, LessThanOrEqual: lambda low, high, v: low <= v,
}


def _fs(path: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _commits(path: str) -> list[str]:
    """Names of the commit listings, in order."""
    from pyarrow import fs as pafs

    fs, root = _fs(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def _files(path: str, commits: list[str]) -> list[str]:
    fs, root = _fs(path)
    out = []
    for name in commits:
        with fs.open_input_file(f"{root}/{COMMITS}/{name}") as f:
            out += json.loads(f.read())
    return out


@dataclass
class Batches(InputPartition):
    """Record batches of a file; None: those that pass the filters, found out by the task."""
    file: str


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class ArrowFiles(DataSource):
    """``spark.read.format("weft_arrow").load(path)``; also ``write`` and ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        path = self.options["path"]
        files = _files(path, _commits(path)[:1])
        if not files:
            raise FileNotFoundError(f"no commits under {path!r}; give a schema")
        fs, root = _fs(path)
        with fs.open_input_file(f"{root}/{files[0]}") as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema.remove_metadata())

    def reader(self, schema):
        return Reader(self.options["path"], schema)

    def streamReader(self, schema):
        return StreamReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], schema, overwrite)


class _Read:
    def __init__(self, path: str, schema):
        self.path, self.columns = path, [f.name for f in schema.fields]
        self.filters: list[tuple] = []

    def read(self, partition: Batches):
        import pyarrow as pa

        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            found = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=None))
            ranges = json.loads((found.schema.metadata or {}).get(b"ranges", b"{}"))
            for k in range(found.num_record_batches):
                if all(self._can_match(ranges, k, *x) for x in self.filters):
                    yield found.get_batch(k).select(self.columns).replace_schema_metadata(None)

    @staticmethod
    def _can_match(ranges: dict, k: int, column: str, kind: type, value) -> bool:
        low_high = ranges.get(column, [None] * (k + 1))[k]
        return low_high is None or _CAN_MATCH[kind](*low_high, value)


class Reader(_Read, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _CAN_MATCH and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) \
                    and not isinstance(f.value, bool):
                self.filters.append((f.attribute[0], type(f), f.value))
            yield f  # batches are skipped, rows are left to Spark

    def partitions(self):
        return [Batches(f) for f in _files(self.path, _commits(self.path))]


class StreamReader(_Read, DataSourceStreamReader):
    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(_commits(self.path))}

    def partitions(self, start, end):
        return [Batches(f) for f in _files(self.path, _commits(self.path)[start["commits"]:end["commits"]])]

    def commit(self, end):
        pass


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema, overwrite: bool):
        if overwrite:
            raise ValueError(f"{FORMAT} folders are append-only: write to a new folder")
        self.path, self.job, self.fields = path, uuid.uuid4().hex, schema

    def write(self, iterator):
        import pyarrow as pa

        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None)
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/{STAGED}/{self.job}")
        name = f"{uuid.uuid4().hex}.arrow"
        schema = batches[0].schema.with_metadata({"ranges": json.dumps(_ranges(batches))})
        with fs.open_output_stream(f"{root}/{STAGED}/{self.job}/{name}") as f, pa.ipc.new_file(f, schema) as out:
            for batch in batches:
                out.write_batch(batch)
        return Written(name)

    def commit(self, messages):
        fs, root = _fs(self.path)
        names = sorted(m.file for m in messages if m is not None and m.file)
        for name in names:
            fs.move(f"{root}/{STAGED}/{self.job}/{name}", f"{root}/{name}")
        fs.create_dir(f"{root}/{COMMITS}")
        number = len(_commits(self.path))
        with fs.open_output_stream(f"{root}/{COMMITS}/.{self.job}") as f:
            f.write(json.dumps(names).encode())
        fs.move(f"{root}/{COMMITS}/.{self.job}", f"{root}/{COMMITS}/{number:08d}.json")
        self._clear(fs, root)

    def abort(self, messages):
        fs, root = _fs(self.path)
        self._clear(fs, root)

    def _clear(self, fs, root):
        from pyarrow import fs as pafs

        if fs.get_file_info(f"{root}/{STAGED}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{STAGED}/{self.job}")


def _ranges(batches: list) -> dict:
    """Minimum and maximum of each number and string column per batch; None where there is none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = {}
    for k, field in enumerate(batches[0].schema):
        kind = field.type
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind):
            found = [pc.min_max(b.column(k)).as_py() for b in batches]
            out[field.name] = [None if m["min"] is None or m["min"] != m["min"] else [m["min"], m["max"]] for m in found]
    return out


def register_arrow(spark: SparkSession) -> str:
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return FORMAT
