"""Phase and step progression.

Orderings inside a member or batch are expressed as aggregates over structs
(``min(struct(order…))``) instead of windows over the whole group:
hash aggregation combines map-side, so a batch holding a third of all rows is
never sorted or buffered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Step and phase status vocabulary.
STEP_SUCCEEDED = "succeeded"
STEP_FAILED = "failed"
STEP_PENDING = "pending"
STEP_IN_PROGRESS = ("dispatched", "polling")
STEP_CANCELLED = "cancelled"
STEP_OPEN = (STEP_PENDING, *STEP_IN_PROGRESS)
PHASE_WAITING = ("pending", "dispatched")
PHASE_COMPLETED = "completed"
PHASE_FAILED = "failed"
PHASE_SKIPPED = "skipped"
PHASE_SUPERSEDED = "superseded"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _order_struct(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)])


def with_step_index(df: DataFrame, steps: str | Column, name: str = "step") -> DataFrame:
    """Expand each member by its phase's step array, keeping the
    0-based position (``posexplode``)."""
    return df.select("*", F.posexplode(_c(steps)).alias(f"{name}_index", name))


def job_id(step_id: str | Column, retry: str | Column | None = None, poll: str | Column | None = None) -> Column:
    """``step-{id}``, ``…-retry-{n}``, ``…-poll-{n}``."""
    out = F.concat(F.lit("step-"), _c(step_id).cast("string"))
    if retry is not None:
        out = F.when(_c(retry) > 0, F.concat(out, F.lit("-retry-"), _c(retry).cast("string"))).otherwise(out)
    if poll is not None:
        out = F.when(_c(poll) > 0, F.concat(out, F.lit("-poll-"), _c(poll).cast("string"))).otherwise(out)
    return out


def next_dispatchable_step(steps: DataFrame, member_keys: Sequence[str], order_by: Sequence[str],
                           status_col: str = "status") -> DataFrame:
    """Per member, the first step (in ``order_by``) that has not
    succeeded — returned only when it is ``pending``.  A member whose first
    unfinished step is in progress or failed has no next step."""
    first_open = (steps.filter(F.col(status_col) != STEP_SUCCEEDED)
                  .groupBy(*member_keys)
                  .agg(F.min(F.struct(_order_struct(order_by).alias("o"), F.col(status_col).alias("s"))).alias("_f")))
    picked = first_open.filter(F.col("_f.s") == STEP_PENDING)
    return picked.select(*member_keys, *[F.col(f"_f.o._o{i}").alias(c) for i, c in enumerate(order_by)])


def phase_outcome(steps: DataFrame, phase_keys: Sequence[str], member_keys: Sequence[str],
                  status_col: str = "status") -> DataFrame:
    """Per phase — ``in_progress`` while any step is pending or in
    progress; ``completed`` when at least one member has all its steps
    succeeded; else ``failed``.  Two-level aggregate (member, then phase)."""
    st = F.col(status_col)
    per_member = steps.groupBy(*phase_keys, *member_keys).agg(
        F.bool_and(st == STEP_SUCCEEDED).alias("_all_ok"),
        F.bool_or(st.isin(STEP_PENDING, *STEP_IN_PROGRESS)).alias("_open"))
    per_phase = per_member.groupBy(*phase_keys).agg(
        F.bool_or("_all_ok").alias("_any_ok"), F.bool_or("_open").alias("_open"))
    return per_phase.select(*phase_keys, F.when(F.col("_open"), F.lit("in_progress"))
                            .when(F.col("_any_ok"), F.lit(PHASE_COMPLETED))
                            .otherwise(F.lit(PHASE_FAILED)).alias("phase_status"))


def with_empty_phases(phases: DataFrame, outcomes: DataFrame, phase_keys: Sequence[str]) -> DataFrame:
    """A phase without any step is completed."""
    return (phases.select(*phase_keys).distinct().join(outcomes, list(phase_keys), "left")
            .withColumn("phase_status", F.coalesce("phase_status", F.lit(PHASE_COMPLETED))))


def batch_outcome(phases: DataFrame, batch_keys: Sequence[str], status_col: str = "phase_status") -> DataFrame:
    """A10: wait while any phase is pending/dispatched/in progress;
    ``completed`` when any phase completed, else ``failed`` (all skipped or
    superseded fails)."""
    st = F.col(status_col)
    agg = phases.groupBy(*batch_keys).agg(
        F.bool_or(st.isin(*PHASE_WAITING, "in_progress")).alias("_wait"),
        F.bool_or(st == PHASE_COMPLETED).alias("_ok"))
    return agg.select(*batch_keys, F.when(F.col("_wait"), F.lit("in_progress"))
                      .when(F.col("_ok"), F.lit(PHASE_COMPLETED)).otherwise(F.lit(PHASE_FAILED)).alias("batch_status"))


def first_and_next_phase(phases: DataFrame, batch_keys: Sequence[str], order_by: Sequence[str],
                         status_col: str = "status") -> DataFrame:
    """Per batch that has a pending or dispatched phase, the first
    pending phase in ``order_by`` (whose first column is the offset), the next
    pending one of greater offset, whether a phase of strictly smaller offset
    is still dispatched (``blocked``), and whether any is (``in_progress``).

    Phases are combined per batch, status and offset first; the two smallest
    offsets are kept by a ranked window, which Spark cuts map-side, so a batch
    holding most phases never meets whole in one task."""
    offset = order_by[0]
    keys = list(batch_keys)
    per_offset = (phases.filter(F.col(status_col).isin(STEP_PENDING, "dispatched"))
                  .groupBy(*keys, F.col(status_col).alias("_s"), F.col(offset).alias("_off"))
                  .agg(F.min(_order_struct(order_by)).alias("_o")))
    rank = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_off"))
    two = per_offset.withColumn("_r", rank).filter(F.col("_r") <= 2)
    pending = F.col("_s") == STEP_PENDING
    out = two.groupBy(*keys).agg(
        F.min(F.when(pending & (F.col("_r") == 1), F.col("_o"))).alias("_first"),
        F.min(F.when(pending & (F.col("_r") == 2), F.col("_o"))).alias("_next"),
        F.min(F.when(~pending, F.col("_off"))).alias("_busy"))
    cols = [F.col(f"_first._o{i}").alias(f"first_{c}") for i, c in enumerate(order_by)]
    cols += [F.col(f"_next._o{i}").alias(f"next_{c}") for i, c in enumerate(order_by)]
    return out.select(*keys, *cols, F.coalesce(F.col("_busy") < F.col("_first._o0"), F.lit(False)).alias("blocked"),
                      F.col("_busy").isNotNull().alias("in_progress"))


def cancel_open_steps(steps: DataFrame, failed_members: DataFrame, member_keys: Sequence[str],
                      status_col: str = "status") -> DataFrame:
    """Every open step (pending, dispatched, polling) of a failed or
    removed member, in all phases, becomes ``cancelled``; all other states,
    ``poll_timeout`` among them, are final."""
    flagged = steps.join(failed_members.select(*member_keys).distinct().withColumn("_hit", F.lit(True)),
                         list(member_keys), "left")
    st = F.col(status_col)
    new = F.when(F.col("_hit") & st.isin(*STEP_OPEN), F.lit(STEP_CANCELLED)).otherwise(st)
    return flagged.withColumn(status_col, new).drop("_hit")


def removal_steps(removed: DataFrame, member_keys: Sequence[str], steps: Sequence[str]) -> DataFrame:
    """For each removed member, one pending execution per
    ``on_member_removed`` step (a literal array exploded — no join)."""
    arr = F.array(*[F.lit(s) for s in steps])
    return removed.select(*member_keys, F.posexplode(arr).alias("step_index", "step_name")).withColumn(
        "status", F.lit(STEP_PENDING))


def version_transition(phases: DataFrame, batch_keys: Sequence[str], new_version: int,
                       version_col: str = "runbook_version") -> DataFrame:
    """Batches that have phases of an older version and none of
    ``new_version`` — the ones to move to the new definition."""
    v = F.col(version_col)
    agg = phases.groupBy(*batch_keys).agg(
        F.bool_or(v < new_version).alias("_old"), F.bool_or(v == new_version).alias("_cur"))
    return agg.filter(F.col("_old") & ~F.col("_cur")).select(*batch_keys)


def new_phase_status(due_at: Column, as_of: Column, overdue_behavior: str | Column,
                     ignore_applied: Column) -> Column:
    """``skipped`` for an overdue phase in ``ignore`` mode on its first
    application, else ``pending`` (``rerun`` re-creates overdue phases)."""
    beh = _c(overdue_behavior) if not isinstance(overdue_behavior, str) else F.lit(overdue_behavior)
    overdue = F.coalesce(due_at <= as_of, F.lit(False))
    return F.when(overdue & (beh == "ignore") & ~ignore_applied, F.lit(PHASE_SKIPPED)).otherwise(F.lit("pending"))


def pending_and_due(phases: DataFrame, as_of: Column, status_col: str = "status", due_col: str = "due_at") -> DataFrame:
    """``status = 'pending' AND due_at <= as_of`` (NULL due is never due)."""
    return phases.filter((F.col(status_col) == "pending") & (F.col(due_col) <= as_of))


def manual_advance_decision(init_pending: Column, init_running: Column, first_pending: Column, blocked: Column,
                            in_progress: Column) -> Column:
    """What an operator's 'advance' does for a manual batch: start its
    init steps, wait for them, dispatch the first pending phase unless an
    earlier one runs, and complete only when no phase is pending or running."""
    return (F.when(init_pending, F.lit("dispatch_init"))
             .when(init_running, F.lit("wait_init"))
             .when(first_pending.isNull() & F.coalesce(in_progress, F.lit(False)), F.lit("wait"))
             .when(first_pending.isNull(), F.lit("completed"))
             .when(blocked, F.lit("wait"))
             .otherwise(F.lit("dispatch_phase")))
