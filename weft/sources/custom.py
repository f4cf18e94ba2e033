"""External connector contract on the Python Data Source API, and JDBC options.

``connect`` / ``validate`` / ``sync`` of a connector map onto a Spark data
source: options are the connection, ``schema()`` validates it, and the reader's
``partitions()`` / ``read()`` do the transfer, one task per partition. The
example connector reads Parquet files split by row group with pyarrow and
yields Arrow record batches, so the work is spread over row groups.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


# Up to this many files the driver reads their footers and plans one partition
# per row group; beyond it, one partition per file (no footer reads on the
# driver, the task reads every row group of its file).
FOOTER_PLANNING_MAX_FILES = 64


@dataclass
class RowGroup(InputPartition):
    path: str
    index: int | None  # None: every row group of the file


def _fs(path: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _files(path: str) -> list[str]:
    from pyarrow import fs as pafs

    fs, root = _fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet"))
    return [root]


def _open(options, file: str):
    import pyarrow.parquet as pq

    fs, _ = _fs(options["path"])
    return pq.ParquetFile(fs.open_input_file(file))


class RowGroupSource(DataSource):
    """``spark.read.format("weft_rowgroups").option("path", …).load()``; the path
    may be local or any URI pyarrow's file systems understand."""

    @classmethod
    def name(cls) -> str:
        return "weft_rowgroups"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Parquet files under {self.options['path']!r}")
        return from_arrow_schema(_open(self.options, files[0]).schema_arrow)

    def reader(self, schema):
        return RowGroupReader(self.options, schema)


class RowGroupReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options = options
        self.columns = [f.name for f in schema.fields]

    def partitions(self):
        files = _files(self.options["path"])
        if len(files) > int(self.options.get("footerPlanningMaxFiles", FOOTER_PLANNING_MAX_FILES)):
            return [RowGroup(f, None) for f in files]
        return [RowGroup(f, i) for f in files for i in range(_open(self.options, f).num_row_groups)]

    def read(self, partition: RowGroup):
        pf = _open(self.options, partition.path)
        groups = range(pf.num_row_groups) if partition.index is None else [partition.index]
        for i in groups:
            yield from pf.read_row_group(i, columns=self.columns).to_batches()


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(RowGroupSource)


def read_rowgroups(spark: SparkSession, path: str, footer_planning_max_files: int = FOOTER_PLANNING_MAX_FILES) -> DataFrame:
    register_sources(spark)
    return (spark.read.format("weft_rowgroups").option("path", path)
            .option("footerPlanningMaxFiles", footer_planning_max_files).load())


def jdbc_options(url: str, *, table: str | None = None, query: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None, fetch_size: int = 10_000, user: str | None = None,
                 password: str | None = None, query_timeout: int = 60) -> dict:
    """Reader options for a remote SQL table or query. A partition column with
    bounds splits the read into ``num_partitions`` range queries run in parallel."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts = {"url": url, "fetchsize": str(fetch_size), "queryTimeout": str(query_timeout)}
    opts["dbtable" if table else "query"] = table or query
    if partition_column:
        if None in (lower, upper, num_partitions):
            raise ValueError("partition_column needs lower, upper and num_partitions")
        if query is not None:
            # range partitioning needs a table expression
            opts.pop("query")
            opts["dbtable"] = f"({query}) q"
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions))
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    return opts


def read_jdbc(spark: SparkSession, url: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, **kw)).load()
