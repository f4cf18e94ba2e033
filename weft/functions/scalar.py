"""Small Column helpers used across operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

MAX_SAFE_INTEGER = 9007199254740991  # 2**53 - 1, largest integer a JSON number keeps exactly

# HTML entities replaced by the escape helper (fixed values, in replacement order).
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(*cols) -> Column:
    """Text that two rows share only if all the columns do: each part follows its length, a null is a mark of its own."""
    parts = [_c(c).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~")) for p in parts])


def html_escape(c) -> Column:
    out = _c(c).cast("string")
    for raw, ent in HTML_ENTITIES:
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out


def safe_int_json(c) -> Column:
    """JSON text of a whole number (also a decimal past 64 bits): a number while exactly representable, else a string."""
    v = _c(c)
    return F.when(v.isNull(), F.lit("null")).when(v.between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER), v.cast("string")) \
        .otherwise(F.concat(F.lit('"'), v.cast("string"), F.lit('"')))


def to_bridge_types(df):
    """Numbers → double, booleans kept, everything else → string (the simple
    three-type interchange; nested values become JSON text)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NumericType):
            cols.append(c.cast("double").alias(f.name))
        elif isinstance(f.dataType, BooleanType):
            cols.append(c.alias(f.name))
        elif f.dataType.typeName() in ("struct", "array", "map", "variant"):
            cols.append(F.to_json(c).alias(f.name))
        else:
            cols.append(c.cast("string").alias(f.name))
    return df.select(*cols)


def wrap_as_list(v: Column) -> Column:
    """Chart data from a VARIANT value: an array stays, an object becomes ``[object]``,
    anything else (scalar, JSON null) becomes ``[]``; a missing value stays NULL."""
    items = F.try_variant_get(v, "$", "array<variant>")
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    return (F.when(v.isNull(), F.lit(None)).when(items.isNotNull(), items)
            .when(is_obj, F.array(v)).otherwise(F.array().cast("array<variant>")))


def search_any_column(df, term: str) -> Column:
    """Case-insensitive ``contains`` over every column's text (nested values as JSON)."""
    texts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("struct", "array", "map", "variant"):
            c = F.to_json(c)
        texts.append(F.lower(c.cast("string")))
    needle = term.lower()
    return F.exists(F.array(*texts), lambda t: F.coalesce(t.contains(needle), F.lit(False)))
