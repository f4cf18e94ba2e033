"""JSON documents composed from queries, per-key documents, chart data and reports.

``compose`` walks the *template* on the driver. Each ``{"$table": …}`` or
``{"$query": …}`` node becomes a one-row aggregate of its rows turned into JSON
text, attached as a scalar subquery; the literal parts of the template are
plain JSON text. The result is one row holding one document, so directive
inputs must be bounded (aggregates, top-k): at most ``max_rows + 1`` rows of a
directive reach its task, and more than ``max_rows`` fails the job rather than
gather an unbounded table into one row or cut the document.

``compose_per_key`` is the scalable form: one document per key, built after a
shuffle on the key (:func:`weft.operators.frames.group_collect`), so the work
spreads over the keys.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.scalar import html_escape
from weft.operators.frames import group_collect

DIRECTIVES = ("$table", "$query")


def _is_directive(node) -> bool:
    return isinstance(node, dict) and any(k in node for k in DIRECTIVES)


def _order_col(k):
    if isinstance(k, str) and k.startswith("-"):
        return -F.col(k[1:])  # descending numeric key
    return F.col(k) if isinstance(k, str) else k


def _rows_json(df: DataFrame, shape: str | None, order_by, max_rows: int, columns=None) -> Column:
    """Scalar subquery: JSON text of ``df``'s rows in the requested shape.

    ``array`` → list; ``object``/``single`` → first row (``{}`` when empty);
    default → object for one row, list otherwise, ``[]`` when empty.
    ``$order_by`` keys may be any column (``-col`` sorts a number descending);
    ``$columns`` limits the fields written.
    """
    if shape == "single" and order_by is None:
        raise ValueError("$as 'single' needs an $order_by so the chosen row is defined")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in (columns or df.columns)]),
                    {"ignoreNullFields": "false"})
    keys = None
    if order_by is not None:
        keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        keys = F.struct(*[_order_col(k) for k in keys])
    if shape in ("object", "single"):
        # one row only: min_by / any_value, nothing is gathered
        first = F.min_by("_j", "_k") if keys is not None else F.any_value("_j")
        src = df.select(keys.alias("_k"), row.alias("_j")) if keys is not None else df.select(row.alias("_j"))
        return src.agg(F.coalesce(first, F.lit("{}")).alias("_doc")).scalar()
    # A document is one value, so its rows meet in one task: at most max_rows + 1
    # of them ever get there, and more than max_rows raises (never a cut document).
    if keys is not None:
        src = df.select(keys.alias("_k"), row.alias("_j")).limit(max_rows + 1)
        rows = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_j"))), lambda r: r["_j"])
    else:
        src = df.select(row.alias("_j")).limit(max_rows + 1)
        rows = F.collect_list("_j")
    n = F.count(F.lit(1))
    guard = F.when(n > max_rows, F.raise_error(F.lit(f"directive has more than {max_rows} rows")))
    arr = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
    if shape == "array":
        text = arr
    else:
        text = F.when(n == 1, F.get(rows, 0)).when(n == 0, F.lit("[]")).otherwise(arr)
    return src.agg(F.coalesce(guard.cast("string"), text).alias("_doc")).scalar()


def _render(node, sources: dict, spark: SparkSession, max_rows: int) -> list:
    """Template → list of Column pieces whose concatenation is the JSON text."""
    if _is_directive(node):
        if "$table" in node:
            df = sources[node["$table"]] if node["$table"] in sources else spark.table(node["$table"])
        else:
            df = spark.sql(node["$query"])
        return [_rows_json(df, node.get("$as"), node.get("$order_by"), max_rows, node.get("$columns"))]
    if isinstance(node, dict):
        parts, first = [F.lit("{")], True
        for k, v in node.items():
            if k.startswith("_"):
                continue
            parts.append(F.lit(("" if first else ",") + json.dumps(k) + ":"))
            parts += _render(v, sources, spark, max_rows)
            first = False
        parts.append(F.lit("}"))
        return parts
    if isinstance(node, list):
        parts = [F.lit("[")]
        for i, v in enumerate(node):
            if i:
                parts.append(F.lit(","))
            parts += _render(v, sources, spark, max_rows)
        parts.append(F.lit("]"))
        return parts
    return [F.lit(json.dumps(node))]


def compose(spark: SparkSession, template: dict | list, sources: dict | None = None,
            max_rows: int = 100_000) -> DataFrame:
    """One row, column ``document``: the template with every directive replaced by rows.
    Keys starting with ``_`` are dropped outside directive nodes."""
    pieces = _render(template, sources or {}, spark, max_rows)
    return spark.range(1).select(F.concat(*pieces).alias("document"))


def compose_per_key(df: DataFrame, key, item_cols, order_by, name: str = "items",
                    head_cols=(), max_items: int | None = None) -> DataFrame:
    """One JSON document per key: ``{head…, name: [items in order]}``.

    A document is one value built in one task; ``max_items`` first checks (one
    small aggregate job, counts per key combined map-side) that no key has more
    items than that, and raises instead of building such a document."""
    keys = [key] if isinstance(key, str) else list(key)
    if max_items is not None:
        worst = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if worst is not None and worst > max_items:
            raise ValueError(f"a key has {worst} items, more than max_items={max_items}")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    item = F.struct(*[F.col(c) for c in item_cols])
    grouped = group_collect(df, [*keys, *head_cols],
                            F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_o"), item.alias("_i"))))
                            .alias("_r"))
    items = F.transform("_r", lambda r: r["_i"])
    doc = F.to_json(F.struct(*[F.col(c) for c in (*keys, *head_cols)], items.alias(name)),
                    {"ignoreNullFields": "false"})
    return grouped.select(*keys, F.size("_r").alias("n_items"), doc.alias("document"))


def chart_data(doc: Column, path: str | None) -> Column:
    """Walk a dot path into a VARIANT document and return chart rows (a list)."""
    from weft.functions.scalar import wrap_as_list

    v = doc
    if path and path.strip():
        v = F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path.strip().split(".")), "variant")
    return wrap_as_list(v)


def chart_bar_avg(df: DataFrame, x: str, y: str, digits: int = 2) -> DataFrame:
    """Chart-sized aggregate: one bar per ``x`` with the mean of ``y``."""
    return df.groupBy(x).agg((F.round(F.avg(y), digits) + 0.0).alias(f"avg_{y}"))


def report_per_key(df: DataFrame, key, cells, order_by) -> DataFrame:
    """Per-key HTML rows (mail merge): cells escaped, one ``<tr>`` per row, rows in order."""
    keys = [key] if isinstance(key, str) else list(key)
    tds = [F.concat(F.lit("<td>"), F.coalesce(html_escape(c), F.lit("")), F.lit("</td>")) for c in cells]
    tr = F.concat(F.lit("<tr>"), *tds, F.lit("</tr>"))
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    grouped = group_collect(
        df, keys, F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_o"), tr.alias("_tr")))).alias("_r"),
        F.count(F.lit(1)).alias("count"))
    return grouped.select(*keys, "count",
                          F.concat(F.lit("<table>"), F.array_join(F.transform("_r", lambda r: r["_tr"]), ""),
                                   F.lit("</table>")).alias("html"))
