"""``{{Variable}}`` template expansion as higher-order Column functions
(F12-F14, V7, U7).

The template is cut into tokens (a whole ``{{name}}``, a run of text, or a
lone ``{``) with one ``regexp_extract_all``; each variable token is looked up
in the member map and the tokens are joined again.  Because values are
substituted once, a value that itself contains ``{{x}}`` is not expanded again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The variable syntax and the two built-in variables.
TOKEN_PATTERN = r"(\{\{\w+\}\}|[^{]+|\{)"
VARIABLE_PATTERN = r"^\{\{(\w+)\}\}$"
BUILTIN_BATCH_ID = "_batch_id"
BUILTIN_BATCH_START = "_batch_start_time"
ISO_ROUND_TRIP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _tokens(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(TOKEN_PATTERN), 1)


def _var(tok: Column) -> Column:
    return F.regexp_extract(tok, VARIABLE_PATTERN, 1)


def _lookup(var: Column, values: Column | None, batch_id: Column | None, batch_start: Column | None) -> Column:
    """Value for one variable name, NULL when unresolved."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if batch_id is not None:
        out = out.when(var == BUILTIN_BATCH_ID, batch_id.cast("string"))
    if batch_start is not None:
        out = out.when(var == BUILTIN_BATCH_START, F.date_format(batch_start, ISO_ROUND_TRIP))
    if values is not None:
        direct = F.try_element_at(values, var)
        has_direct = F.array_contains(F.map_keys(values), var)
        alt_name = F.concat(F.lit("_"), var)
        alt = F.try_element_at(values, alt_name)
        has_alt = F.array_contains(F.map_keys(values), alt_name)
        # a present key with a NULL value resolves to ""
        out = out.when(has_direct, F.coalesce(direct, F.lit(""))).when(has_alt, F.coalesce(alt, F.lit("")))
    return out


def expand(template: str | Column, values: str | Column | None = None,
           batch_id: str | Column | None = None, batch_start: str | Column | None = None) -> Column:
    """``struct(text, unresolved)`` — the expanded text (unresolved
    variables left as written) and the array of unresolved names.

    With ``values=None`` only the built-ins resolve (init steps, F13)."""
    t = _c(template)
    v = None if values is None else _c(values)
    bid = None if batch_id is None else _c(batch_id)
    bst = None if batch_start is None else _c(batch_start)
    toks = _tokens(t)

    def render(tok: Column) -> Column:
        var = _var(tok)
        return F.when(var == "", tok).otherwise(F.coalesce(_lookup(var, v, bid, bst), tok))

    def unresolved(tok: Column) -> Column:
        var = _var(tok)
        return (var != "") & _lookup(var, v, bid, bst).isNull()

    return F.struct(
        F.when(t.isNotNull(), F.array_join(F.transform(toks, render), "")).alias("text"),
        F.transform(F.filter(toks, unresolved), _var).alias("unresolved"),
    )


def expand_params(params: str | Column, values: str | Column | None = None,
                  batch_id: str | Column | None = None, batch_start: str | Column | None = None) -> Column:
    """expand every value of a ``map<string,string>`` of parameter
    templates; returns ``struct(params, unresolved)``."""
    p = _c(params)
    expanded = F.transform_values(p, lambda k, t: expand(t, values, batch_id, batch_start).text)
    missing = F.flatten(F.transform(F.map_values(p),
                                    lambda t: expand(t, values, batch_id, batch_start).unresolved))
    return F.struct(expanded.alias("params"), F.array_distinct(missing).alias("unresolved"))


def template_variables(template: str | Column) -> Column:
    """Distinct variable names used by a template."""
    return F.array_distinct(F.regexp_extract_all(_c(template), F.lit(r"\{\{(\w+)\}\}"), 1))


def brace_balance_error(template: str | Column) -> Column:
    """V7: running depth over the ``{{`` / ``}}`` tokens — error text when a
    ``}}`` comes before its ``{{`` or the depth is not 0 at the end."""
    toks = F.regexp_extract_all(_c(template), F.lit(r"(\{\{|\}\})"), 1)
    steps = F.transform(toks, lambda x: F.when(x == "{{", F.lit(1)).otherwise(F.lit(-1)))
    state = F.aggregate(
        steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, s: F.struct((acc.depth + s).alias("depth"), F.least(acc.low, acc.depth + s).alias("low")))
    return (F.when(state.low < 0, F.lit("unexpected closing braces"))
             .when(state.depth != 0, F.lit("unclosed template braces")))
