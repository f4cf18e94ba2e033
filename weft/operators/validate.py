"""JSON Schema validation as Column expressions.

The schema is compiled once on the driver into one expression per rule; every
document of a table is then checked in the JVM (whole-stage codegen, no Python
per row). Documents are parsed once into VARIANT. Supported keywords: type,
required, properties, enum, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, minLength, maxLength, pattern, items, minItems, maxItems,
additionalProperties (false). Any other validation keyword raises instead of
being silently ignored; annotations (title, description, x-*, …) are skipped.

Messages follow the usual validator wording with an instance path:
``data/query/name must be string``. ``errors`` lists every failure in schema
order; the first one is what a stop-at-first-error validator reports.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import spread_rows

# Error message formats of the validator, per keyword (fixed values).
MESSAGES = {
    "type": "must be {types}",
    "required": "must have required property '{name}'",
    "additionalProperties": "must NOT have additional properties",
    "maxLength": "must NOT have more than {n} characters",
    "minLength": "must NOT have fewer than {n} characters",
    "pattern": 'must match pattern "{pattern}"',
    "maximum": "must be <= {n}",
    "minimum": "must be >= {n}",
    "exclusiveMaximum": "must be < {n}",
    "exclusiveMinimum": "must be > {n}",
    "maxItems": "must NOT have more than {n} items",
    "minItems": "must NOT have fewer than {n} items",
    "enum": "must be equal to one of the allowed values",
    "json": "data must be valid JSON",
}

_ANNOTATIONS = {"title", "description", "$schema", "$id", "default", "examples", "$comment", "format"}
_SUPPORTED = {"type", "required", "properties", "enum", "minimum", "maximum", "exclusiveMinimum",
              "exclusiveMaximum", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems",
              "additionalProperties"}
_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


class UnsupportedSchema(ValueError):
    pass


def _kind(v: Column, s: Column | None = None) -> Column:
    """JSON type name of a VARIANT value (SQL NULL when the value is missing).
    ``s`` is the value's ``schema_of_variant`` when it is already a column."""
    s = F.schema_of_variant(v) if s is None else s
    num = s.isin(*_NUMERIC) | s.startswith("DECIMAL")
    d = F.try_variant_get(v, "$", "double")
    return (F.when(v.isNull(), F.lit(None))
            .when(s == "VOID", "null")
            .when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY"), "array")
            .when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean")
            .when(num & (d == F.floor(d)), "integer")
            .when(num, "number")
            .otherwise("other"))


def _type_ok(kind: Column, types) -> Column:
    allowed = set(types)
    if "number" in allowed:
        allowed.add("integer")
    return kind.isin(*sorted(allowed))


def _msg(path: Column, text: str) -> Column:
    return F.concat(F.lit("data"), path, F.lit(" " + text))


def _fmt_num(x) -> str:
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _fails(cond: Column, message: Column) -> Column:
    """One check: ``[message]`` when ``cond`` holds, else ``[]`` (never null), so
    the checks concatenate without a null-dropping pass (a lambda, which would
    take the whole projection out of code generation)."""
    return F.when(cond, F.array(message)).otherwise(_no_errors())


def _own_checks(v: Column, kind: Column, schema: dict, path: Column) -> list[Column]:
    """Error-message arrays for the node's own keywords (not its properties)."""
    unknown = set(schema) - _SUPPORTED - _ANNOTATIONS
    unknown = {k for k in unknown if not k.startswith("x-")}
    if unknown:
        raise UnsupportedSchema(f"unsupported JSON Schema keyword(s): {sorted(unknown)}")
    out: list[Column] = []
    present = v.isNotNull()
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        out.append(_fails(present & ~_type_ok(kind, types), _msg(path, MESSAGES["type"].format(types=",".join(types)))))
    is_obj, is_arr = present & (kind == "object"), present & (kind == "array")
    is_str, is_num = present & (kind == "string"), present & kind.isin("integer", "number")

    for r in schema.get("required", []):
        sub = F.try_variant_get(v, f"$['{r}']", "variant")
        out.append(_fails(is_obj & sub.isNull(), _msg(path, MESSAGES["required"].format(name=r))))
    props = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        keys = F.json_object_keys(F.to_json(v))
        extra = F.filter(keys, lambda k: ~k.isin(*props.keys())) if props else keys
        out.append(_fails(is_obj & (F.size(extra) > 0),
                                  _msg(path, MESSAGES["additionalProperties"])))

    s = F.try_variant_get(v, "$", "string")
    if "maxLength" in schema:
        out.append(_fails(is_str & (F.char_length(s) > schema["maxLength"]),
                                  _msg(path, MESSAGES["maxLength"].format(n=schema["maxLength"]))))
    if "minLength" in schema:
        out.append(_fails(is_str & (F.char_length(s) < schema["minLength"]),
                                  _msg(path, MESSAGES["minLength"].format(n=schema["minLength"]))))
    if "pattern" in schema:
        out.append(_fails(is_str & ~s.rlike(schema["pattern"]),
                                  _msg(path, MESSAGES["pattern"].format(pattern=schema["pattern"]))))

    d = F.try_variant_get(v, "$", "double")
    for kw, op in (("maximum", lambda a, b: a > b), ("minimum", lambda a, b: a < b),
                   ("exclusiveMaximum", lambda a, b: a >= b), ("exclusiveMinimum", lambda a, b: a <= b)):
        if kw in schema:
            out.append(_fails(is_num & op(d, F.lit(float(schema[kw]))),
                                      _msg(path, MESSAGES[kw].format(n=_fmt_num(schema[kw])))))

    arr = F.try_variant_get(v, "$", "array<variant>")
    if "maxItems" in schema:
        out.append(_fails(is_arr & (F.size(arr) > schema["maxItems"]),
                                  _msg(path, MESSAGES["maxItems"].format(n=schema["maxItems"]))))
    if "minItems" in schema:
        out.append(_fails(is_arr & (F.size(arr) < schema["minItems"]),
                                  _msg(path, MESSAGES["minItems"].format(n=schema["minItems"]))))
    if isinstance(schema.get("items"), dict):
        item_schema = schema["items"]

        def per_item(x, i):
            msgs = _inline(x, item_schema, F.concat(path, F.lit("/"), i.cast("string")))
            return F.flatten(F.array(*msgs)) if msgs else _no_errors()

        out.append(F.coalesce(F.when(is_arr, F.flatten(F.transform(arr, per_item))), _no_errors()))

    if "enum" in schema:
        allowed = [json.dumps(x, separators=(",", ":"), sort_keys=True) for x in schema["enum"]]
        out.append(_fails(present & ~F.to_json(v).isin(*allowed),
                                  _msg(path, MESSAGES["enum"])))
    return out


def _inline(v: Column, schema: dict, path: Column) -> list[Column]:
    """Checks for array items (inside a lambda, where nothing can be materialised)."""
    out = _own_checks(v, _kind(v), schema, path)
    for name, sub_schema in schema.get("properties", {}).items():
        sub = F.when(_kind(v) == "object", F.try_variant_get(v, f"$['{name}']", "variant"))
        out += _inline(sub, sub_schema or {}, F.concat(path, F.lit(f"/{name}")))
    return out


def _nodes(schema: dict) -> list[tuple[int, list[str], dict]]:
    """Schema nodes reachable through ``properties`` in depth-first (schema) order:
    (id, property path from the root, schema)."""
    out = []

    def walk(sch, names):
        out.append((len(out), names, sch or {}))
        for pname, psch in (sch or {}).get("properties", {}).items():
            walk(psch, names + [pname])

    walk(schema, [])
    return out


def _json_path(names) -> str:
    return "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in names)


def _check_frame(df: DataFrame, v: Column, schema: dict, errors: str) -> DataFrame:
    """Every node's value is read from the root document by its full path (a
    missing or non-object parent yields SQL NULL, so no check fires below a type
    error), and its value and JSON type are materialised once as columns."""
    if isinstance(schema, str):
        schema = json.loads(schema)
    nodes = _nodes(schema)
    base = df.columns
    df = df.withColumn("_jv0", v)
    df = df.withColumns({f"_jv{nid}": F.try_variant_get(F.col("_jv0"), _json_path(names), "variant")
                         for nid, names, _ in nodes[1:]})
    df = df.withColumns({f"_js{nid}": F.schema_of_variant(F.col(f"_jv{nid}")) for nid, _, _ in nodes})
    df = df.withColumns({f"_jk{nid}": _kind(F.col(f"_jv{nid}"), F.col(f"_js{nid}")) for nid, _, _ in nodes})
    pieces = []
    for nid, names, sch in nodes:
        path = "".join("/" + n for n in names)
        pieces += _own_checks(F.col(f"_jv{nid}"), F.col(f"_jk{nid}"), sch, F.lit(path))
    empty = _no_errors()
    msgs = F.flatten(F.array(*pieces)) if pieces else empty
    # ``errors`` comes out of a one-row generator: a later filter on it (valid /
    # rejected split) cannot be pushed below a generator's output, so Catalyst
    # does not substitute the staged columns into the filter (which would
    # re-parse every document once per reference instead of once).
    df = df.withColumn("_errors", msgs)
    return df.select(*base, F.inline(F.array(F.struct(F.col("_errors").alias(errors)))))


def compile_schema(schema: dict | str):
    """Driver-side compile into an inline ``fn(variant_column) -> array<string>``
    (for use inside other expressions; :func:`validate` is the staged, faster form)."""
    if isinstance(schema, str):
        schema = json.loads(schema)

    def check(v: Column) -> Column:
        pieces = _inline(v, schema, F.lit(""))
        return F.flatten(F.array(*pieces)) if pieces else _no_errors()

    return check


def validate(df: DataFrame, schema: dict | str, text: str | None = None, variant: str | None = None,
             errors: str = "errors", spread: bool = False) -> DataFrame:
    """Adds ``errors array<string>`` for every row: from a JSON text column (parsed
    with ``try_parse_json``; unparseable → ``data must be valid JSON``) or from a
    VARIANT column.

    Checking is CPU-bound per row. ``spread=True`` (for an input that is a file
    scan) first spreads an input with fewer partitions than the cluster has
    cores (one small file, one row group) round-robin over them; see
    :func:`weft.session.spread_rows`.
    """
    if spread:
        df = spread_rows(df)
    if variant is not None:
        return _check_frame(df, F.col(variant), schema, errors)
    checked = _check_frame(df.withColumn("_jdoc", F.try_parse_json(F.col(text))), F.col("_jdoc"), schema, errors)
    return (checked.withColumn(errors, F.when(F.col("_jdoc").isNull(), F.array(F.lit(MESSAGES["json"])))
                               .otherwise(F.col(errors))).drop("_jdoc"))


def valid_rows(checked: DataFrame, errors: str = "errors") -> DataFrame:
    return checked.where(F.size(errors) == 0)


def rejected_rows(checked: DataFrame, errors: str = "errors") -> DataFrame:
    return checked.where(F.size(errors) > 0)


def error_text(errors: str = "errors") -> Column:
    """All messages as one text, the way a validator's error summary reads."""
    return F.array_join(F.col(errors), ", ")
