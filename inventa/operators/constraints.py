"""V8: declared constraints of tables, checked in one scan and one grouped pass.

A table's declaration names its required columns, value domains, unique keys and
references.  Required columns and domains are decided row by row in the scan;
unique keys and references become (constraint, key) pairs that are counted
together, the child rows and the parent rows of a reference under one key, so no
constraint needs a join of its own and a hot key is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    """``domains``: name -> (column, values); ``unique``: name -> columns;
    ``references``: name -> (column, parent table, parent column)."""

    required: tuple[str, ...] = ()
    domains: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    unique: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    references: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)


_STEP_STATUSES = ("pending", "dispatched", "succeeded", "failed", "polling", "poll_timeout")

# Constraints of the seven tables.
TABLES = {
    "runbooks": Constraints(
        ("id", "name", "version", "yaml_content", "data_table_name", "is_active", "overdue_behavior", "ignore_overdue_applied",
         "rerun_init", "created_at"),
        {"CK_overdue_behavior": ("overdue_behavior", ("rerun", "ignore"))},
        {"PK_runbooks": ("id",), "UQ_runbook_name_version": ("name", "version")}),
    "runbook_automation_settings": Constraints(
        ("runbook_name", "automation_enabled"), unique={"PK_runbook_automation_settings": ("runbook_name",)}),
    "batches": Constraints(
        ("id", "runbook_id", "status", "detected_at", "is_manual"),
        {"CK_batch_status": ("status", ("detected", "init_dispatched", "active", "completed", "failed"))},
        {"PK_batches": ("id",), "UQ_batch": ("runbook_id", "batch_start_time")},
        {"FK_batch_runbook": ("runbook_id", "runbooks", "id")}),
    "batch_members": Constraints(
        ("id", "batch_id", "member_key", "status", "added_at"),
        {"CK_member_status": ("status", ("active", "removed", "failed"))},
        {"PK_batch_members": ("id",), "UQ_batch_member": ("batch_id", "member_key")},
        {"FK_member_batch": ("batch_id", "batches", "id")}),
    "phase_executions": Constraints(
        ("id", "batch_id", "phase_name", "offset_minutes", "runbook_version", "status"),
        {"CK_phase_status": ("status", ("pending", "dispatched", "completed", "failed", "skipped", "superseded"))},
        {"PK_phase_executions": ("id",), "UQ_phase_exec": ("batch_id", "phase_name", "runbook_version")},
        {"FK_phase_batch": ("batch_id", "batches", "id")}),
    "step_executions": Constraints(
        ("id", "phase_execution_id", "batch_member_id", "step_name", "step_index", "status", "is_poll_step", "poll_count", "retry_count"),
        {"CK_step_status": ("status", (*_STEP_STATUSES, "cancelled", "rolled_back", "skipped"))},
        {"PK_step_executions": ("id",), "UQ_step_exec": ("phase_execution_id", "batch_member_id", "step_name")},
        {"FK_step_phase": ("phase_execution_id", "phase_executions", "id"), "FK_step_member": ("batch_member_id", "batch_members", "id")}),
    "init_executions": Constraints(
        ("id", "batch_id", "step_name", "step_index", "runbook_version", "status", "is_poll_step", "poll_count", "retry_count"),
        {"CK_init_status": ("status", _STEP_STATUSES)},
        {"PK_init_executions": ("id",), "UQ_init_exec": ("batch_id", "step_name", "runbook_version")},
        {"FK_init_batch": ("batch_id", "batches", "id")}),
}


def _text(*columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def violations(tables: Mapping[str, DataFrame], declared: Mapping[str, Constraints] = TABLES) -> DataFrame:
    """(table, constraint, key, n): ``key`` is the offending value or key as JSON
    (c0, c1, ...), ``n`` the rows that have it.

    As in SQL, null passes a domain and a reference, a unique key takes nulls as
    equal values, and only tables that are given are checked; a reference to a
    table that is not given is an error."""
    pairs, seen = [], []
    for name, c in declared.items():
        if name not in tables:
            continue
        rows = tables[name]
        failed = [F.when(F.col(x).isNull(), F.struct(F.lit(f"NN_{name}_{x}").alias("constraint"), F.lit(None).cast("string").alias("key")))
                  for x in c.required]
        failed += [F.when(F.col(x).isNotNull() & ~F.col(x).isin(*values), F.struct(F.lit(n).alias("constraint"), _text(F.col(x)).alias("key")))
                   for n, (x, values) in c.domains.items()]
        if failed:
            seen.append(rows.select(F.lit(name).alias("table"), F.explode(F.filter(F.array(*failed), lambda f: f.isNotNull())).alias("f"))
                        .select("table", "f.*"))
        keys = [(n, "unique", _text(*[F.col(x) for x in cols])) for n, cols in c.unique.items()]
        keys += [(n, "child", F.when(F.col(x).isNotNull(), _text(F.col(x)))) for n, (x, _, _) in c.references.items()]
        if keys:
            each = F.array(*[F.struct(F.lit(n).alias("constraint"), F.lit(role).alias("role"), key.alias("key")) for n, role, key in keys])
            pairs.append(rows.select(F.lit(name).alias("table"), F.explode(each).alias("p")).select("table", "p.*"))
        for n, (_, parent, column) in c.references.items():
            if parent not in tables:
                raise ValueError(f"{n} refers to {parent}, which is not given")
            pairs.append(tables[parent].select(F.lit(name).alias("table"), F.lit(n).alias("constraint"), F.lit("parent").alias("role"),
                                               _text(F.col(column)).alias("key")))
    parts = []
    if seen:
        rows = seen[0]
        for more in seen[1:]:
            rows = rows.unionByName(more)
        parts.append(rows.groupBy("table", "constraint", "key").agg(F.count(F.lit(1)).alias("n")))
    if pairs:
        rows = pairs[0]
        for more in pairs[1:]:
            rows = rows.unionByName(more)
        counted = rows.where(F.col("key").isNotNull()).groupBy("table", "constraint", "key").agg(
            *[F.count_if(F.col("role") == r).alias(r) for r in ("unique", "child", "parent")])
        parts.append(counted.where("unique > 1 OR (child > 0 AND parent = 0)")
                     .select("table", "constraint", "key", F.greatest("unique", "child").alias("n")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
