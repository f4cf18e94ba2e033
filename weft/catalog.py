"""Named tables: publish, load, list and save (the named-table bridge).

A name maps to a lazy DataFrame registered as a temp view, so SQL steps and
DataFrame steps see the same tables. Saving writes Parquet to a new versioned
directory and switches the view only after the write succeeded, so a table can
be rebuilt from itself without reading a half-written folder.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from weft.sources.files import TABLE_NAMES, read_input


class TableNotFound(KeyError):
    pass


def register(df: DataFrame, name: str) -> DataFrame:
    """Publish ``df`` under ``name`` (replaces an existing table or view)."""
    df.createOrReplaceTempView(name)
    return df


def unregister(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def load(spark: SparkSession, name: str) -> DataFrame:
    """Existing table by name; the error lists what is available."""
    if not spark.catalog.tableExists(name):
        names = sorted(t.name for t in spark.catalog.listTables())
        raise TableNotFound(f"table {name!r} not found; available: {', '.join(names) or '(none)'}")
    return spark.table(name)


def list_tables(spark: SparkSession, names=None, with_counts: bool = False) -> DataFrame:
    """Saved/published tables as a DataFrame (name, is_temporary[, n_rows]).

    With ``with_counts`` every listed table is counted in one job: a union of
    per-table global aggregates, each a partial count per scan task.
    """
    listed = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()
              if names is None or t.name in names]
    if not with_counts:
        return spark.createDataFrame(listed, "name string, is_temporary boolean")
    if not listed:
        return spark.createDataFrame([], "name string, is_temporary boolean, n_rows bigint")
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("name"), F.lit(tmp).alias("is_temporary"), "n_rows") for n, tmp in listed]
    return reduce(DataFrame.unionAll, parts)


def list_databases(spark: SparkSession) -> DataFrame:
    """Databases the catalog knows, as a DataFrame (name, description)."""
    rows = [(d.name, d.description) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "name string, description string")


def _list_dir(spark: SparkSession, root: str) -> list[str]:
    """Entry names under ``root`` through Hadoop's FileSystem (any shared storage)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(st.getPath().getName() for st in fs.listStatus(path))


def register_folder(spark: SparkSession, root: str, names=None) -> list[str]:
    """Publish every ``<name>.parquet`` under ``root`` as a view (query across them)."""
    found = []
    for entry in _list_dir(spark, root):
        if not entry.endswith(".parquet"):
            continue
        name = entry[: -len(".parquet")]
        if names is not None and name not in names:
            continue
        register(read_input(spark, root.rstrip("/") + "/" + entry), name)
        found.append(name)
    return found


def register_tables(spark: SparkSession, sf_dir: str, names=TABLE_NAMES) -> None:
    register_folder(spark, sf_dir, set(names))


def is_nested(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (StructType, ArrayType, MapType, VariantType)) for f in df.schema.fields)


def save(df: DataFrame, name: str, root: str, mode: str = "overwrite") -> DataFrame:
    """Persist ``df`` as Parquet in a fresh versioned folder and publish it.

    Returns the DataFrame read back from storage, which is what later steps
    should use: its lineage starts at the files, not at the inputs.
    """
    spark = df.sparkSession
    path = os.path.join(root, name, f"v-{uuid.uuid4().hex}")
    df.write.mode(mode).option("compression", "zstd").parquet(path)  # half of snappy's bytes where ids are hex text
    # the schema is the one just written: no inference job on the read-back
    saved = spark.read.schema(df.schema).parquet(path)
    register(saved, name)
    return saved


def run_statements(spark: SparkSession, name: str, statements: list[str]) -> dict[str, DataFrame]:
    """Run a step's SQL statements in order (given as a list: no splitter here).
    Every statement that yields a result, ``WITH …`` included, is published
    lazily: statement 1 as ``name``, statement n > 1 as ``name_n``, numbered by
    position. Statements without a result (DDL) only take effect."""
    out = {}
    for n, text in enumerate(statements, start=1):
        df = spark.sql(text)
        if not df.columns:
            continue
        table = name if n == 1 else f"{name}_{n}"
        out[table] = register(df, table)
    return out


def save_step(df: DataFrame, name: str, root: str) -> tuple[DataFrame, int]:
    """Save a step's output and return it with its row count. The count is an
    ``Observation`` metric collected by the write itself, not a second pass."""
    from pyspark.sql import Observation

    obs = Observation(f"rows_{name}_{uuid.uuid4().hex[:8]}")
    saved = save(df.observe(obs, F.count(F.lit(1)).alias("rows")), name, root)
    return saved, int(obs.get["rows"])


def save_auto(df: DataFrame, name: str, root: str, key_cols=None, depth_limit: int = 5,
              stage_input: bool = True) -> dict:
    """Save a flat frame as one table, a nested one as shredded linked tables.

    Each shredded table is its own write, and each write would scan and parse
    the input again (a JSON source once per child table). With ``stage_input``
    the nested rows are written once as Parquet and every table reads that.
    """
    from weft.operators.nested import shred

    if not is_nested(df):
        return {name: save(df, name, root)}
    if stage_input:
        df = save(df, f"{name}__nested", root)
    parts = shred(df, name, key_cols=key_cols, depth_limit=depth_limit)
    return {t: save(part, t, root) for t, part in parts.items()}


def catalog_columns(spark: SparkSession, names=None) -> DataFrame:
    """Tables × columns with ordinal position, from the session catalog (schemas only)."""
    rows = []
    for t in spark.catalog.listTables():
        if names is not None and t.name not in names:
            continue
        for pos, c in enumerate(spark.catalog.listColumns(t.name), start=1):
            rows.append((t.name, c.name, pos, c.dataType))
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string")


def lineage_stamp(df: DataFrame, git_hash: str, run_id: str, step_id: str) -> DataFrame:
    """Row stamp kept apart from any shredding metadata (``_lineage``)."""
    stamp = F.to_json(F.struct(F.lit(git_hash).alias("git_hash"), F.lit(run_id).alias("run_id"),
                               F.lit(step_id).alias("cell_id")))
    return df.withColumn("_lineage", stamp)


def lineage_log(step_inputs: dict[str, DataFrame], output_name: str, output: DataFrame,
                namespace: str = "weft") -> DataFrame:
    """Input/output lineage of one step as rows: direction, table, files, row count.

    File lists come from the plans (``inputFiles``); the row counts are one
    Spark job over a union of per-table counts.
    """
    parts = []
    for direction, name, df in [*(("input", n, d) for n, d in step_inputs.items()),
                                ("output", output_name, output)]:
        files = len(df.inputFiles())
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(direction).alias("direction"), F.lit(namespace).alias("namespace"), F.lit(name).alias("name"),
            F.lit(files).alias("n_files"), "n_rows"))
    return reduce(DataFrame.unionAll, parts)


def shared_columns(columns: DataFrame) -> DataFrame:
    """Column names that occur in more than one table of a catalog listing."""
    return (columns.groupBy("column_name")
            .agg(F.countDistinct("table_name").alias("n_tables"))
            .where(F.col("n_tables") > 1))


def table_columns(columns: DataFrame) -> DataFrame:
    """Columns grouped per table, in ordinal order."""
    return (columns.groupBy("table_name")
            .agg(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("cols"))
            .select("table_name", F.transform("cols", lambda c: c["column_name"]).alias("columns")))
