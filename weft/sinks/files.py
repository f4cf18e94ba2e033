"""Sinks: Parquet, CSV, JSON lines, Markdown rows, and result preview."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from weft.session import ensure_checkpoint_dir


class EmptyExport(ValueError):
    pass


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    root = ensure_checkpoint_dir(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, "weft-scratch", purpose, uuid.uuid4().hex)


def _guard(df: DataFrame, allow_empty: bool) -> None:
    if not allow_empty and df.isEmpty():
        raise EmptyExport("nothing to export: the table has no rows")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None,
                  allow_empty: bool = True) -> str:
    _guard(df, allow_empty)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", allow_empty: bool = False) -> str:
    """CSV with a header; nested values are written as JSON text."""
    _guard(df, allow_empty)
    flat = df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(
        f.dataType, (StructType, ArrayType, MapType)) else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields])
    flat.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite", allow_empty: bool = False) -> str:
    """JSON lines; nulls kept as ``null`` like the row objects they come from."""
    _guard(df, allow_empty)
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def _cell_text(c: Column, dtype) -> Column:
    if isinstance(dtype, (StructType, ArrayType, MapType, VariantType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(text, r"\|", r"\\|")
    return F.regexp_replace(text, r"\r?\n", " ")


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as one Markdown table line: null → '', nested values as JSON,
    ``|`` escaped, newlines → space."""
    cells = [_cell_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + "|".join(["---"] * len(df.columns)) + "|"]


def preview_page(df: DataFrame, order_by, page: int = 0, size: int = 100) -> DataFrame:
    """Page ``page`` (0-based) of ``size`` rows in a total order."""
    cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return df.orderBy(*cols).offset(page * size).limit(size)
