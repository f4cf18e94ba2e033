"""weft: table and document pipelines as plain PySpark DataFrame operators.

Every operator takes and returns DataFrames (or Columns), so pipelines are
written with ``df.transform`` and Spark SQL; Catalyst and AQE plan them.
"""

from weft.catalog import list_tables, load, register, run_statements, save, save_auto, save_step
from weft.operators.asof import join_asof
from weft.operators.compose import chart_bar_avg, chart_data, compose, compose_per_key, report_per_key
from weft.operators.frames import group_collect, grouped_pandas_agg, grouped_udaf, page, pivot_mean, search
from weft.operators.gates import evaluate_rules, gate_passes, gated, gated_with_fallback, quality_metrics
from weft.operators.nested import max_children, rebuild, shred
from weft.operators.runs import (
    abort_propagation,
    dry_run,
    group_status,
    latest_state,
    log_truncate,
    run_first_error,
    stop_after_output,
)
from weft.operators.sync import (
    batch_outcomes,
    batch_payloads,
    batch_plan,
    batch_send,
    delete,
    insert,
    key_violations,
    sync_summary,
    update,
    upsert,
)
from weft.operators.validate import rejected_rows, valid_rows, validate
from weft.session import cut_lineage, spread_rows

__all__ = [
    "abort_propagation", "batch_outcomes", "batch_payloads", "batch_plan", "batch_send", "chart_bar_avg",
    "chart_data", "compose", "compose_per_key", "cut_lineage", "delete", "dry_run", "evaluate_rules",
    "gate_passes", "gated", "gated_with_fallback", "group_collect", "group_status", "grouped_pandas_agg",
    "grouped_udaf", "insert", "join_asof", "key_violations", "latest_state", "list_tables", "load",
    "log_truncate", "max_children", "page", "pivot_mean", "quality_metrics", "rebuild", "register",
    "rejected_rows", "report_per_key", "run_first_error", "run_statements", "save", "save_auto", "save_step",
    "search", "shred", "spread_rows", "stop_after_output", "sync_summary", "update", "upsert", "valid_rows",
    "validate",
]
