"""File sources: Parquet, CSV, JSON lines, irregular JSON as VARIANT, Excel (gated)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Schemas of input tables already read, by path and the time it was last written. An explicit
# schema spares every later read the footer-inference job.
_SCHEMAS: dict[tuple, StructType] = {}


def _status(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet input, a file or a folder. Its schema is read again once the path was rewritten."""
    status = _status(spark, path)
    key = (path, status.getModificationTime(), status.getLen())
    schema = _SCHEMAS.get(key)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Parquet keeps filters and column pruning at the scan."""
    return read_input(spark, table_path(sf_dir, name))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_parquet(spark: SparkSession, path: str, schema: StructType | None = None, **options) -> DataFrame:
    """A Parquet table as a stream, stored as one file or as a folder of part files that may grow.

    A file source lists folders only; a lone file is named by a pattern that matches nothing else."""
    schema = schema or spark.read.parquet(path).schema
    folder = _status(spark, path).isDirectory()
    return spark.readStream.schema(schema).options(**options).parquet(path if folder else f"{path[:-1]}[{path[-1]}]")


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """CSV with a header. An explicit schema avoids the extra inference pass over the data."""
    reader = spark.read.option("header", header)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """JSON lines (splittable) by default. ``multi_line`` reads each file as one
    document/array and therefore costs one task per file: convert such input to
    JSON lines or Parquet once at ingestion. Without ``schema`` Spark infers one
    in an extra pass over all the input; at scale pass the schema, or read
    irregular input as VARIANT (:func:`read_json_variant`), which needs none."""
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_json_variant(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Irregular JSON: every record as one VARIANT column ``v``; a top-level array
    in a multi-line file is exploded into one row per element."""
    df = spark.read.option("singleVariantColumn", "v").option("multiLine", multi_line).json(path)
    if not multi_line:
        return df
    items = F.expr("try_variant_get(v, '$', 'array<variant>')")
    return (df.select(F.when(items.isNull(), F.array("v")).otherwise(items).alias("items"))
            .select(F.explode("items").alias("v")))


def json_to_lines(spark: SparkSession, src: str, dst: str) -> str:
    """One-off conversion of multi-line JSON arrays into splittable JSON lines."""
    read_json(spark, src, multi_line=True).write.mode("overwrite").json(dst)
    return dst


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Excel workbook → one table per sheet, row 1 as header, blank header → ``Col<n>``.

    Each workbook is read by one task (``binaryFile`` + ``mapInPandas``); the
    workbooks themselves are spread over tasks. Needs ``openpyxl``, which is
    not installed here, so the reader raises a clear error instead.
    """
    try:
        import openpyxl  # noqa: F401
    except ImportError as exc:  # pragma: no cover - depends on environment
        raise RuntimeError("read_excel needs openpyxl, which is not installed") from exc

    import io

    import pandas as pd

    def sheets(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                book = pd.read_excel(io.BytesIO(content), sheet_name=sheet if sheet else None, header=0)
                if not isinstance(book, dict):
                    book = {sheet: book}
                for name, frame in book.items():
                    frame.columns = [c if isinstance(c, str) and not c.startswith("Unnamed")
                                     else f"Col{i + 1}" for i, c in enumerate(frame.columns)]
                    yield pd.DataFrame({"path": p, "sheet": name,
                                        "row_json": frame.astype(str).to_json(orient="records", lines=True)
                                        .splitlines()})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(sheets, "path string, sheet string, row_json string")
