"""Validation rules as violation DataFrames.

Every rule yields rows ``(rule, item[, detail])`` — nothing is collected to
the driver; a job reports the violations table or fails on a non-empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventa.functions.durations import duration_seconds, offset_minutes, offset_publishable
from inventa.functions.templates import brace_balance_error, template_variables


def violations(df: DataFrame, rule: str, item: Column, condition: Column, detail: Column | None = None) -> DataFrame:
    d = detail if detail is not None else F.lit(None).cast("string")
    return df.filter(condition).select(F.lit(rule).alias("rule"), item.cast("string").alias("item"),
                                       d.cast("string").alias("detail"))


def duplicate_names(df: DataFrame, scope: Sequence[str], name: str, rule: str = "duplicate_name") -> DataFrame:
    """Names used more than once within ``scope``."""
    g = df.groupBy(*scope, F.lower(F.col(name)).alias("_n")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    item = F.concat_ws("/", *[F.col(c).cast("string") for c in scope], F.col("_n"))
    return g.select(F.lit(rule).alias("rule"), item.alias("item"), F.col("_c").cast("string").alias("detail"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _listed(df: DataFrame, item: Column, checks: Sequence[tuple[str, Column, Column | None]]) -> DataFrame:
    """One row per failed check ``(rule, condition, detail)``: all checks of a
    row are one array, exploded, so the input is read once."""
    found = F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), item.cast("string").alias("item"),
                                            (F.lit(None) if detail is None else detail).cast("string").alias("detail")))
                      for rule, cond, detail in checks])
    return df.select(F.explode(F.array_compact(found)).alias("v")).select("v.*")


def step_rules(steps: DataFrame, runbook: str, step: str, function: str, worker: str | None = None,
               offset: str | None = None, poll_interval: str | None = None, poll_timeout: str | None = None,
               params_template: str | None = None, rollback: str | None = None,
               known_rollbacks: DataFrame | None = None, output_params: str | None = None) -> DataFrame:
    """Runbook step rules: required name, worker and function,
    duplicate step names, phase offsets, poll settings (both required and each
    a duration, in any relation), template braces, output parameters (a map
    whose keys and values must not be blank), unknown rollbacks."""
    item = F.concat_ws("/", F.col(runbook).cast("string"), F.col(step).cast("string"))
    checks: list[tuple[str, Column, Column | None]] = [
        ("missing_name", _blank(F.col(step)), None), ("missing_function", _blank(F.col(function)), None)]
    if worker is not None:
        checks.append(("missing_worker", _blank(F.col(worker)), None))
    if offset is not None:
        bad = F.coalesce(~offset_publishable(F.col(offset)), F.lit(True)) | offset_minutes(F.col(offset)).isNull()
        checks += [("missing_offset", _blank(F.col(offset)), None),
                   ("bad_offset", ~_blank(F.col(offset)) & bad, F.col(offset))]
    if poll_interval is not None and poll_timeout is not None:
        polling = F.col(poll_interval).isNotNull() | F.col(poll_timeout).isNotNull()
        for name, c in (("poll_interval", F.col(poll_interval)), ("poll_timeout", F.col(poll_timeout))):
            checks += [(f"missing_{name}", polling & _blank(c), None),
                       (f"bad_{name}", ~_blank(c) & duration_seconds(c).isNull(), c)]
    if params_template is not None:
        err = brace_balance_error(F.col(params_template))
        checks.append(("template_braces", err.isNotNull(), err))
    if output_params is not None:
        entries = F.map_entries(F.col(output_params))
        checks += [("blank_output_param", F.coalesce(F.exists(entries, lambda e: _blank(e.key)), F.lit(False)), None),
                   ("blank_output_field", F.coalesce(F.exists(entries, lambda e: _blank(e.value)), F.lit(False)), None)]
    out = _listed(steps, item, checks).unionByName(duplicate_names(
        steps.filter(~_blank(F.col(step))), [runbook], step, "duplicate_step"))
    if rollback is not None and known_rollbacks is not None:
        rb = known_rollbacks.select(F.col(rollback).alias("_rb")).distinct()
        x = steps.filter(~_blank(F.col(rollback))).join(rb, F.col(rollback) == F.col("_rb"), "left_anti")
        out = out.unionByName(x.select(F.lit("unknown_rollback").alias("rule"), item.alias("item"),
                                       F.col(rollback).cast("string").alias("detail")))
    return out


def phase_rules(runbooks: DataFrame, phases: DataFrame, runbook: str, phase: str, offset: str, n_steps: str) -> DataFrame:
    """V6: a runbook has at least one phase; a phase has a name unique in its
    runbook (letter case aside), a publishable offset and at least one step."""
    item = F.concat_ws("/", F.col(runbook).cast("string"), F.col(phase).cast("string"))
    o = F.col(offset)
    bad = F.coalesce(~offset_publishable(o), F.lit(True)) | offset_minutes(o).isNull()
    own = _listed(phases, item, [
        ("missing_phase_name", _blank(F.col(phase)), None), ("missing_offset", _blank(o), None),
        ("bad_offset", ~_blank(o) & bad, o), ("no_steps", F.coalesce(F.col(n_steps), F.lit(0)) == 0, None)])
    none = (runbooks.select(runbook).distinct().join(phases.select(runbook).distinct(), runbook, "left_anti")
            .select(F.lit("no_phases").alias("rule"), F.col(runbook).cast("string").alias("item"),
                    F.lit(None).cast("string").alias("detail")))
    twice = duplicate_names(phases.filter(~_blank(F.col(phase))), [runbook], phase, "duplicate_phase")
    return own.unionByName(none).unionByName(twice)


def expected_columns(steps: DataFrame, runbook: str, template: str, key_column: Column,
                     output_params: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Per runbook, the member columns a CSV must carry: the key and extra
    (batch time, multi-valued) columns as they are, and every template variable
    that is neither an output parameter nor ``_``-prefixed.  Names that differ
    in letter case alone are one column, spelt as the first in order."""
    found = F.filter(template_variables(F.col(template)), lambda v: ~v.startswith("_"))
    if output_params:
        found = F.filter(found, lambda v: ~F.lower(v).isin(*[o.lower() for o in output_params]))
    named = F.concat(F.array(key_column, *[F.lit(e) for e in extra]), F.coalesce(found, F.array().cast("array<string>")))
    cols = steps.select(F.col(runbook), F.explode(named).alias("column_name")).filter(F.col("column_name").isNotNull())
    return cols.groupBy(runbook, F.lower("column_name").alias("_l")).agg(F.min("column_name").alias("column_name")).drop("_l")


def attribute_mismatches(expected: DataFrame, current: DataFrame, key: str, attr: str,
                         multi_valued: bool = False) -> DataFrame:
    """V9: expected attribute vs current value (string compare, or
    membership in a multi-valued attribute)."""
    x = expected.join(current.select(F.col(key), F.col(attr).alias("_cur")), key, "left")
    if multi_valued:
        ok = F.coalesce(F.array_contains(F.col("_cur"), F.col(attr).cast("string")), F.lit(False))
    else:
        ok = F.coalesce(F.col("_cur").cast("string") == F.col(attr).cast("string"), F.lit(False))
    return x.withColumn("matches", ok).drop("_cur")


def verify_membership(pairs: DataFrame, memberships: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag each (group, user) pair found in the membership table."""
    m = memberships.select(*keys).distinct().withColumn("is_member", F.lit(True))
    return pairs.join(m, list(keys), "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))


def required_fields(df: DataFrame, fields: Sequence[str], item: Column, rule: str = "missing_field") -> DataFrame:
    """V3/V4: a row missing (NULL or blank) one of ``fields``; one violation
    per missing field."""
    out = None
    for f in fields:
        v = violations(df, rule, item, F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True)), F.lit(f))
        out = v if out is None else out.unionByName(v)
    return out


AUTH_METHODS = ("managed_identity", "service_principal")


def tenant_rules(tenants: DataFrame, key: str = "tenant_key") -> DataFrame:
    """V3: tenant keys are unique, as written."""
    g = tenants.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    return g.select(F.lit("duplicate_tenant").alias("rule"), F.col("_k").cast("string").alias("item"),
                    F.col("_c").cast("string").alias("detail"))


def storage_auth_rules(storage: DataFrame, item: str = "name", method: str = "method",
                       fields: Sequence[str] = ("tenant_id", "client_id", "cert_name")) -> DataFrame:
    """V3: a known authentication method; a service principal needs its tenant,
    client and certificate."""
    m = F.col(method)
    principal = F.coalesce(m == "service_principal", F.lit(False))
    return _listed(storage, F.col(item), [
        ("bad_auth_method", F.coalesce(~m.isin(*AUTH_METHODS), F.lit(True)), m),
        *[("missing_auth_field", principal & _blank(F.col(f)), F.lit(f)) for f in fields]])


def job_rules(jobs: DataFrame, entities: DataFrame, tenants: DataFrame, job: str = "name") -> DataFrame:
    """A job has a name; the entities and tenants it includes or
    excludes exist; its tiers are 1-5; mode ``specific`` lists tenant_keys and
    ``all_except`` lists exclude_keys.  Array columns that the configuration
    lacks count as empty."""
    from inventa.operators.runs import TENANT_MODES, TIER_RANGE
    lo, hi = TIER_RANGE

    def listed(c: str, dtype: str = "string") -> Column:
        none = F.array().cast(f"array<{dtype}>")
        return F.coalesce(F.col(c).cast(f"array<{dtype}>"), none) if c in jobs.columns else none

    mode = F.col("tenant_mode")
    bad_tiers = F.filter(listed("include_tiers", "int"), lambda t: ~t.between(lo, hi))
    own = _listed(jobs, F.col(job), [
        ("missing_job_name", _blank(F.col(job)), None),
        ("bad_tier", F.size(bad_tiers) > 0, F.array_join(bad_tiers.cast("array<string>"), ",")),
        ("unknown_tenant_mode", ~mode.isin(*TENANT_MODES), mode),
        ("tenant_list_required", (mode == "specific") & (F.size(listed("tenant_keys")) == 0), F.lit("tenant_keys")),
        ("tenant_list_required", (mode == "all_except") & (F.size(listed("exclude_keys")) == 0), F.lit("exclude_keys"))])
    fields = {"include_entities": "entity", "exclude_entities": "entity", "tenant_keys": "tenant", "exclude_keys": "tenant"}
    none = "CAST(array() AS array<struct<kind: string, n: string, field: string>>)"
    arrays = [F.expr(f"coalesce(transform({c}, x -> named_struct('kind', '{k}', 'n', x, 'field', '{c}')), {none})")
              if c in jobs.columns else F.expr(none) for c, k in fields.items()]
    named = F.concat(*arrays)
    known = (entities.select(F.lit("entity").alias("kind"), F.col("name").alias("n"))
             .unionByName(tenants.select(F.lit("tenant").alias("kind"), F.col("tenant_key").alias("n"))).distinct())
    refs = jobs.select(F.col(job).cast("string").alias("item"), F.explode(named).alias("r")).select("item", "r.*")
    unknown = refs.join(known, ["kind", "n"], "left_anti").select(
        F.concat(F.lit("unknown_"), "kind").alias("rule"), "item", F.concat_ws(":", "field", "n").alias("detail"))
    return own.unionByName(unknown)


def domain_violations(df: DataFrame, column: str, allowed: Sequence[str], item: Column, rule: str) -> DataFrame:
    """V8: CHECK constraint — a value outside its allowed set."""
    return violations(df, rule, item, ~F.col(column).isin(*allowed) | F.col(column).isNull(), F.col(column))
