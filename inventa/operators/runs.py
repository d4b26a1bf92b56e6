"""Ingestion runs: entity and tenant selection, run plan, task rollup,
timeouts, overlap, config checks and versions (U3-U5, J12, J18, A8, A11,
A14, T18, T19, V2-V4, V8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BAD_TASK_STATUSES = ("failed", "timeout", "dispatch_failed")
OPEN_TASK_STATUSES = ("pending", "running", "dispatched")
RUN_TIMEOUT_HOURS = 8
TENANT_MODES = ("all", "specific", "all_except")
TIER_RANGE = (1, 5)
# Upper bound on rows of a configuration table that is broadcast or


def select_entities(registry: DataFrame, tiers: Sequence[int], include: Sequence[str] = (),
                    exclude: Sequence[str] = (), name: str = "name", tier: str = "tier") -> DataFrame:
    """``(entities of tiers ∪ include) − exclude``, each once, registry
    order kept in the ``ordinal`` column."""
    picked = registry.filter(F.col(tier).isin(*tiers) | F.col(name).isin(*include))
    if exclude:
        picked = picked.filter(~F.col(name).isin(*exclude))
    return picked.dropDuplicates([name])


def select_tenants(tenants: DataFrame, mode: str, keys: DataFrame | None = None,
                   key: str = "tenant_key", enabled: str = "enabled") -> DataFrame:
    """U4: ``all`` / ``specific`` / ``all_except`` over enabled tenants; an
    unknown mode raises."""
    if mode not in TENANT_MODES:
        raise ValueError(f"unknown tenant selection mode: {mode}")
    on = tenants.filter(F.col(enabled))
    if mode == "all":
        return on
    if keys is None:
        raise ValueError(f"mode {mode} needs tenant keys")
    ks = keys.select(F.col(key)).distinct()
    return on.join(ks, key, "left_semi" if mode == "specific" else "left_anti")


def override_tenants(enabled_tenants: DataFrame, override: DataFrame, key: str = "tenant_key") -> DataFrame:
    """The enabled tenants that are in the override list."""
    return enabled_tenants.join(override.select(key).distinct(), key, "left_semi")


def container_groups(entities: DataFrame, container: str = "container", name: str = "name",
                     ordinal: str = "ordinal") -> DataFrame:
    """Per container, its entities in registry order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(name).alias("n"))))
    return entities.groupBy(F.col(container).alias("container")).agg(
        F.transform(ordered, lambda e: e["n"]).alias("entities"))


#: join keys over which the container groups of a run plan are dealt
DEALS = 8


def run_plan(tenants: DataFrame, groups: DataFrame, key: str = "tenant_key") -> DataFrame:
    """One task per tenant × container group.  The groups are dealt by
    container and every tenant asks for each deal, so the plan is an equi-join
    that Spark may broadcast or shuffle, whatever the registry holds."""
    asked = tenants.select(key, F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_deal"))
    dealt = groups.withColumn("_deal", F.pmod(F.xxhash64("container"), F.lit(DEALS)).cast("int"))
    return asked.join(dealt, "_deal").select(key, "container", "entities")


def run_outcome(tasks: DataFrame, run_keys: Sequence[str], status_col: str = "status") -> DataFrame:
    """``failed`` when all tasks are bad, ``completed_with_errors`` when
    some are, else ``completed``; ``running`` while a task is still open."""
    st = F.col(status_col)
    agg = tasks.groupBy(*run_keys).agg(
        F.bool_and(st.isin(*BAD_TASK_STATUSES)).alias("_all_bad"),
        F.bool_or(st.isin(*BAD_TASK_STATUSES)).alias("_any_bad"),
        F.bool_or(st.isin(*OPEN_TASK_STATUSES)).alias("_open"))
    return agg.select(*run_keys, F.when(F.col("_open"), F.lit("running"))
                      .when(F.col("_all_bad"), F.lit("failed"))
                      .when(F.col("_any_bad"), F.lit("completed_with_errors"))
                      .otherwise(F.lit("completed")).alias("run_status"))


def run_outcome_after_timeout(tasks: DataFrame, run_keys: Sequence[str], ts_col: str, as_of: Column,
                              status_col: str = "status", hours: int = RUN_TIMEOUT_HOURS) -> DataFrame:
    """T18/A11 in one aggregate: a run whose first task is older than ``hours``
    at ``as_of`` has its open tasks timed out, then the run is rolled up.  All
    partial counts combine map-side; no join, no window."""
    st = F.col(status_col)
    agg = tasks.groupBy(*run_keys).agg(
        F.min(ts_col).alias("_start"), F.count(F.lit(1)).alias("_n"),
        F.count_if(st.isin(*OPEN_TASK_STATUSES)).alias("_open"), F.count_if(st.isin(*BAD_TASK_STATUSES)).alias("_bad"))
    late = F.coalesce(F.col("_start") < F.timestamp_add("HOUR", F.lit(-hours), as_of), F.lit(False))
    timed = F.when(late, F.col("_open")).otherwise(F.lit(0))
    bad = F.col("_bad") + timed
    return agg.select(*run_keys, timed.cast("long").alias("n_timed_out"),
                      F.when(F.col("_open") > timed, F.lit("running")).when(bad == F.col("_n"), F.lit("failed"))
                      .when(bad > 0, F.lit("completed_with_errors")).otherwise(F.lit("completed")).alias("run_status"))


def timeout_open_tasks(tasks: DataFrame, run_started: str | Column, as_of: Column,
                       status_col: str = "status", hours: int = RUN_TIMEOUT_HOURS) -> DataFrame:
    """Open tasks of runs older than ``hours`` at ``as_of`` become ``timeout``."""
    started = F.col(run_started) if isinstance(run_started, str) else run_started
    late = started < F.timestamp_add("HOUR", F.lit(-hours), as_of)
    st = F.col(status_col)
    return tasks.withColumn(status_col, F.when(late & st.isin(*OPEN_TASK_STATUSES), F.lit("timeout")).otherwise(st))


def overlap_decision(jobs: DataFrame, open_runs: DataFrame, job_col: str = "job_name") -> DataFrame:
    """A job whose name (case-insensitive) has an open run is
    ``skipped_overlap``, else ``started``."""
    busy = open_runs.select(F.lower(F.col(job_col)).alias("_j")).distinct().withColumn("_busy", F.lit(True))
    return (jobs.withColumn("_j", F.lower(F.col(job_col))).join(busy, "_j", "left")
            .withColumn("decision", F.when(F.col("_busy"), F.lit("skipped_overlap")).otherwise(F.lit("started")))
            .drop("_j", "_busy"))


def missing_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent (anti join)."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def next_version(versions: DataFrame, name: str, version: str) -> DataFrame:
    """Next version = max + 1 per name; publishing it deactivates every
    row below it, the current top version included.  One partial aggregate,
    no join: a name holding most rows is combined map-side."""
    return versions.groupBy(name).agg((F.max(version) + 1).alias("next_version"),
                                      F.count(F.lit(1)).alias("n_deactivated"))
