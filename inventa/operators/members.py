"""Batch and member operators.

Member keys compare case-insensitively.  Every set operation is a join of
*distinct* key sets, so no key fans out, and each distinct is a hash
aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventa.functions.jsonmap import row_to_json
from inventa.functions.durations import batch_time_floor, lenient_timestamp


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_norm(c: str | Column) -> Column:
    return F.lower(_c(c))


def batch_groups(rows: DataFrame, batch_time: str | Column | None, as_of: str | Column | None = None,
                 member_key: str = "member_key") -> DataFrame:
    """Rows of a query result grouped by their batch time.

    With a batch-time column the text is parsed leniently (invalid or blank →
    the row is skipped); without one every row belongs to the immediate batch
    at ``as_of`` floored to the 5-minute tick.  One row per batch time with
    its member count (no member lists are gathered)."""
    if batch_time is None:
        ts = batch_time_floor(_c(as_of) if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp"))
        grouped = rows.withColumn("batch_time", ts)
    else:
        col = _c(batch_time)
        parsed = lenient_timestamp(col.cast("string"))
        grouped = rows.withColumn("batch_time", parsed).filter(F.col("batch_time").isNotNull())
    return grouped.groupBy("batch_time").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(key_norm(member_key)).alias("n_members"))


def member_diff(current: DataFrame, active: DataFrame, current_key: str, active_key: str) -> DataFrame:
    """``added`` = current − active, ``removed`` = active − current, by
    lower-cased key, duplicates collapsed.  Output ``(member_key, change)``."""
    cur = current.select(key_norm(current_key).alias("member_key")).distinct().withColumn("_in_cur", F.lit(True))
    act = active.select(key_norm(active_key).alias("member_key")).distinct().withColumn("_in_act", F.lit(True))
    both = cur.join(act, "member_key", "full_outer")
    return both.select("member_key", F.when(F.col("_in_act").isNull(), F.lit("added"))
                       .when(F.col("_in_cur").isNull(), F.lit("removed")).alias("change")
                       ).filter(F.col("change").isNotNull())


def in_active_batch(candidates: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EXISTS — candidates already in an active batch (left semi join)."""
    return candidates.join(active.select(*keys).distinct(), list(keys), "left_semi")


def drop_active_elsewhere(candidates: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NOT EXISTS — drop candidates active elsewhere / already processed."""
    return candidates.join(active.select(*keys).distinct(), list(keys), "left_anti")


def refresh_members(active: DataFrame, current: DataFrame, active_key: str, current_key: str) -> DataFrame:
    """Active members still present in the query get the fresh row
    (inner join on the lower-cased key; the fresh side is first reduced to one
    row per key so a duplicated result row cannot fan out)."""
    fresh = (current.withColumn("_k", key_norm(current_key))
             .groupBy("_k").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in current.columns]),
                                         F.col(f"`{current_key}`")).alias("_fresh")))
    return (active.withColumn("_k", key_norm(active_key))
            .join(fresh, "_k", "inner").select(*[F.col(f"`{c}`") for c in active.columns], "_fresh").drop("_k"))


def add_members(requested: DataFrame, active: DataFrame, requested_key: str, active_key: str,
                group_by: Sequence[str] = ()) -> DataFrame:
    """Members to add are requested keys not already active; counts of
    added and skipped (already active), optionally per group."""
    act = active.select(key_norm(active_key).alias("_k")).distinct().withColumn("_active", F.lit(True))
    req = requested.select(*group_by, key_norm(requested_key).alias("_k")).distinct()
    flagged = req.join(act, "_k", "left")
    return flagged.groupBy(*group_by).agg(
        F.count_if(F.col("_active").isNull()).alias("n_added"),
        F.count_if(F.col("_active").isNotNull()).alias("n_skipped"))


def active_member_counts(members: DataFrame, batch_col: str, status_col: str,
                         inactive: Sequence[str] = ("removed", "failed")) -> DataFrame:
    """Active members per batch."""
    return (members.filter(~F.col(status_col).isin(*inactive))
            .groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_active_members")))


def undispatched(members: DataFrame, dispatched_at: str = "add_dispatched_at") -> DataFrame:
    """Members whose add was not dispatched yet."""
    return members.filter(F.col(dispatched_at).isNull())


def new_batch_status(has_init_steps: Column) -> Column:
    """A new batch starts ``init_dispatched`` when it has init steps."""
    return F.when(has_init_steps, F.lit("init_dispatched")).otherwise(F.lit("active"))


def batch_id_for(runbook: str | Column, batch_time: str | Column) -> Column:
    """Set-based batch ids without identity columns (see README)."""
    return F.xxhash64(_c(runbook), _c(batch_time))


FINISHED_BATCH = ("completed", "failed")


def detect_batches(rows: DataFrame, runbook: str, member_key: str, batch_time: str | Column | None,
                   existing_batches: DataFrame, stored_members: DataFrame, phases: Column,
                   has_init_steps: bool = False, as_of: Column | None = None,
                   data_columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """One pass of batch detection over a query result.

    * Rows are grouped by their (lenient) batch time, or, in immediate mode
      (``batch_time`` None), by the 5-minute tick of ``as_of``.  Immediate rows
      whose member is active in an unfinished batch are left out.
    * A group whose batch id is not stored yet is a new batch, with its member
      snapshot (``data_json`` of the row) and one pending phase execution per
      runbook phase (``phases``: literal array of ``struct(phase_name,
      offset_minutes)``).  A group left without members makes no batch.
    * Of a stored batch that is not completed or failed, the members added and
      removed are returned, and the fresh ``data_json`` of the active ones
      still in the result; finished batches are left alone.

    ``existing_batches`` has batch_id and may have status; ``stored_members``
    batch_id, member_key and may have status (missing: active).  Rows are parsed
    and reduced to one per batch and member once, all outputs follow from that."""
    def having(df: DataFrame, status: str) -> DataFrame:
        return df if "status" in df.columns else df.withColumn("status", F.lit(status))

    bt = batch_time_floor(as_of) if batch_time is None else lenient_timestamp(_c(batch_time).cast("string"))
    data = row_to_json(data_columns or rows.columns)
    known = having(existing_batches, "active").select("batch_id", F.col("status").alias("_status")).distinct()
    stored = having(stored_members, "active").select("batch_id", key_norm("member_key").alias("member_key"), "status")
    stored = stored.join(known.filter(~F.col("_status").isin(*FINISHED_BATCH)).select("batch_id"), "batch_id", "left_semi")
    members = (rows.select(bt.alias("_bt"), key_norm(member_key).alias("member_key"), data.alias("data_json"))
               .filter(F.col("_bt").isNotNull()).withColumn("batch_id", batch_id_for(F.lit(runbook), F.col("_bt")))
               .groupBy("batch_id", "_bt", "member_key").agg(F.max("data_json").alias("data_json")))
    active = stored.filter(F.col("status") == "active")
    if batch_time is None:
        members = members.join(active.select("member_key").distinct(), "member_key", "left_anti")
    members = members.join(known, "batch_id", "left")
    fresh = members.filter(F.col("_status").isNull())
    new_batches = (fresh.groupBy("batch_id", F.col("_bt").alias("batch_start_time"))
                   .agg(F.count(F.lit(1)).alias("n_members"))
                   .withColumn("runbook", F.lit(runbook))
                   .withColumn("status", new_batch_status(F.lit(has_init_steps))))
    new_members = fresh.select("batch_id", "member_key", F.lit("active").alias("status"), "data_json")
    new_phases = (new_batches.select("batch_id", "batch_start_time", F.explode(phases).alias("_p"))
                  .select("batch_id", F.col("_p.phase_name").alias("phase_name"),
                          F.col("_p.offset_minutes").alias("offset_minutes"),
                          F.timestamp_add("MINUTE", -F.col("_p.offset_minutes"), F.col("batch_start_time")).alias("due_at"),
                          F.lit("pending").alias("status")))
    cur = (members.filter(~F.col("_status").isin(*FINISHED_BATCH))
           .select("batch_id", "member_key", "data_json", F.lit(True).alias("_c")))
    # a batch of which nothing is left in the result has no group here, so it is
    # not touched; within a touched batch every stored active member is compared
    touched = members.filter(F.col("_status").isNotNull()).select("batch_id").distinct()
    sto = (active.join(touched, "batch_id", "left_semi").select("batch_id", "member_key").distinct()
           .withColumn("_s", F.lit(True)))
    both = cur.join(sto, ["batch_id", "member_key"], "full_outer")
    changes = (both.select("batch_id", "member_key", "data_json", F.when(F.col("_s").isNull(), F.lit("added"))
                           .when(F.col("_c").isNull(), F.lit("removed")).otherwise(F.lit("refreshed")).alias("change")))
    return {"new_batches": new_batches, "new_members": new_members, "new_phases": new_phases,
            "member_changes": changes.filter(F.col("change") != "refreshed"),
            "refreshed": changes.filter(F.col("change") == "refreshed").drop("change")}
