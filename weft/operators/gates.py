"""Quality metrics, gated steps, fallback branches and rule evaluation.

A gate is a predicate over a one-row metrics frame. It is attached to the
gated frame as a scalar subquery: Spark computes the metrics once, and the
gated plan stays one lazy plan with no join at all.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_metrics(df: DataFrame, **bad_conditions: Column) -> DataFrame:
    """One row: ``total`` plus one ``<name>`` count per condition (map-side partial agg)."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bad_conditions.items()]
    return df.agg(*aggs)


def _predicate(expr, on_error: str, columns) -> Column:
    """Compile a rule to a Column; a broken rule follows the ``on_error`` policy."""
    if isinstance(expr, Column):
        return F.coalesce(expr, F.lit(False))
    if expr is None or not str(expr).strip():
        return F.lit(True)
    try:
        col = F.expr(expr)
        return F.coalesce(col, F.lit(False))
    except (ParseException, AnalysisException) as exc:
        return _broken(expr, on_error, exc)


def _broken(expr, on_error: str, exc) -> Column:
    msg = f"failed to evaluate condition {expr!r}: {exc}"
    if on_error == "raise":
        raise ValueError(msg) from exc
    warnings.warn(msg + f"; policy {on_error!r}", stacklevel=3)
    return F.lit(on_error == "run")


def gate_value(metrics: DataFrame, predicate, on_error: str = "run") -> Column:
    """The gate as a scalar-subquery Column (true / false, never null)."""
    pred = _predicate(predicate, on_error, metrics.columns)
    try:
        return metrics.select(pred.alias("_pass")).scalar()
    except AnalysisException as exc:
        return _broken(predicate, on_error, exc)


def gated(df: DataFrame, metrics: DataFrame, predicate, on_error: str = "run") -> DataFrame:
    """``df`` when the predicate over ``metrics`` holds, else an empty frame of the same schema."""
    return df.where(gate_value(metrics, predicate, on_error))


def gated_with_fallback(df: DataFrame, fallback: DataFrame, metrics: DataFrame, predicate,
                        on_error: str = "run") -> DataFrame:
    """Main branch when the gate passes, the fallback branch otherwise (the rollback)."""
    ok = gate_value(metrics, predicate, on_error)
    return df.where(ok).unionByName(fallback.where(~ok))


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def gate_passes(metrics: DataFrame, predicate, on_error: str = "run") -> bool:
    """Eager variant: one row to the driver, so a caller can skip a write entirely."""
    pred = _predicate(predicate, on_error, metrics.columns)
    try:
        return bool(metrics.select(pred.alias("p")).first()["p"])
    except AnalysisException as exc:
        return bool(metrics.select(_broken(predicate, on_error, exc).alias("p")).first()["p"])


def evaluate_rules(context: DataFrame, rules: dict[str, str], on_error: str = "run") -> DataFrame:
    """One boolean column per rule over each context row; null counts as false."""
    out = context
    for name, text in rules.items():
        pred = _predicate(text, on_error, context.columns)
        try:
            out = out.withColumn(name, pred)
            out.schema  # noqa: B018 - forces analysis so unknown names surface here
        except AnalysisException as exc:
            out = out.withColumn(name, _broken(text, on_error, exc))
    return out


def map_columns(source_columns, target_columns) -> tuple[list[str], list[str]]:
    """Case-insensitive mapping of source columns onto a target schema: (valid, skipped)."""
    target = {c.lower(): c for c in target_columns}
    valid = [c for c in source_columns if c.lower() in target]
    skipped = [c for c in source_columns if c.lower() not in target]
    return valid, skipped
