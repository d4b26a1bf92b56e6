"""Member data as JSON maps, multi-valued cells, worker results
(F10, F11, F15-F18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multi-valued column formats.
SEMICOLON = "semicolon_delimited"
COMMA = "comma_delimited"
JSON_ARRAY = "json_array"
STRING_MAP = "map<string,string>"
WHITESPACE = " \t\n\r\x0b\x0c"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_to_string_map(columns: Sequence[str]) -> Column:
    """a row as ``map<string,string>`` in column order; NULL → ""."""
    parts = []
    for c in columns:
        parts += [F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))]
    return F.create_map(*parts)


def row_to_json(columns: Sequence[str]) -> Column:
    """the member ``data_json`` text."""
    return F.to_json(row_to_string_map(columns))


def multi_value_array(value: str | Column, fmt: str | Column) -> Column:
    """a delimited cell as ``array<string>`` — empties removed, parts
    trimmed; unknown formats split on ``;``; NULL/"" → NULL."""
    v = _c(value)
    f = F.lower(_c(fmt)) if not isinstance(fmt, str) else F.lit(fmt.lower())
    pieces = F.when(f == COMMA, F.split(v, ",")).otherwise(F.split(v, ";"))
    parts = F.filter(pieces, lambda x: x != "")
    # .NET Trim(): all leading/trailing white space, not only blanks
    trimmed = F.transform(parts, lambda x: F.btrim(x, F.lit(WHITESPACE)))
    return F.when(v.isNull() | (v == ""), F.lit(None)).otherwise(trimmed)


def multi_value_json(value: str | Column, fmt: str | Column) -> Column:
    """the JSON-array text stored for a multi-valued column.
    ``json_array`` cells are kept as written when they parse (else NULL and
    :func:`multi_value_error` says why)."""
    v = _c(value)
    f = F.lower(_c(fmt)) if not isinstance(fmt, str) else F.lit(fmt.lower())
    return (F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
             .when(f == JSON_ARRAY, F.when(F.try_parse_json(v).isNotNull(), v))
             .otherwise(F.to_json(multi_value_array(v, f))))


def multi_value_error(value: str | Column, fmt: str | Column) -> Column:
    v = _c(value)
    f = F.lower(_c(fmt)) if not isinstance(fmt, str) else F.lit(fmt.lower())
    return F.when((f == JSON_ARRAY) & (v != "") & F.try_parse_json(v).isNull(),
                  F.concat(F.lit("Value is not valid JSON for json_array column: "), v))


def parse_string_map(text: str | Column) -> Column:
    """JSON object text → ``map<string,string>``; bad JSON → empty map."""
    m = F.from_json(_c(text), STRING_MAP)
    return F.coalesce(m, F.create_map().cast(STRING_MAP))


def merge_worker_data(member: str | Column, worker: str | Column) -> Column:
    """member data overlaid by worker output, worker wins on equal keys.
    Independent of ``spark.sql.mapKeyDedupPolicy``."""
    m, w = _c(member), _c(worker)
    kept = F.map_filter(m, lambda k, _v: ~F.array_contains(F.map_keys(w), k))
    return F.map_concat(kept, w)


def json_field_ci(result_json: str | Column, field: str | Column) -> Column:
    """F16: value of a top-level field matched case-insensitively: strings
    raw, other values as JSON text; NULL when missing or not an object."""
    m = F.from_json(_c(result_json), STRING_MAP)
    fld = F.lower(_c(field)) if not isinstance(field, str) else F.lit(field.lower())
    hit = F.map_filter(m, lambda k, _v: F.lower(k) == fld)
    return F.try_element_at(F.map_values(hit), F.lit(1))


def still_polling(status: str | Column, result_json: str | Column) -> Column:
    """a Success result whose ``complete`` field is the JSON boolean
    false (the text ``"false"`` is not)."""
    fields = F.from_json(_c(result_json), "map<string,variant>")
    hit = F.map_values(F.map_filter(fields, lambda k, _v: F.lower(k) == "complete"))
    comp = F.try_element_at(hit, F.lit(1))
    return F.coalesce((_c(status) == "Success") & (F.schema_of_variant(comp) == "BOOLEAN")
                      & (F.to_json(comp) == "false"), F.lit(False))


def final_result(result_json: str | Column) -> Column:
    """the ``data`` field when present (NULL for a JSON null), else the
    whole result."""
    fields = F.from_json(_c(result_json), STRING_MAP)
    present = F.exists(F.map_keys(fields), lambda k: F.lower(k) == "data")
    return F.when(present, json_field_ci(result_json, "data")).otherwise(_c(result_json))
