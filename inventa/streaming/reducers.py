"""Stateful stream operators.

* :func:`result_state_stream` — T9/T10: worker results folded per step with
  ``applyInPandasWithState``.  Within a micro-batch results are applied in
  event order; across micro-batches in arrival order.  The state per step is
  five numbers, so it does not grow with the number of results.
* :func:`checkin_stream` — T21: device check-ins upserted per (user, device)
  with an additive count, in ``foreachBatch`` on a versioned table.
* :func:`transition_rows` — T9: single guarded step transitions (compare-and-set)
  as a join with the allowed-transition table; whole batches of requests are
  folded by :mod:`inventa.operators.transitions`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inventa.operators.results import RESULT_FAILURE, RESULT_POLLING, RESULT_SUCCESS
from inventa.sources.tables import VersionedTable

RESULT_STATE = "status string, failures int, n_applied long, n_ignored long"
RESULT_OUT = "step_key string, final_status string, failures int, n_applied long, n_ignored long"
TERMINAL = ("succeeded", "failed", "poll_timeout", "cancelled")

# Allowed step status transitions (from, to).
STEP_TRANSITIONS = (
    ("pending", "dispatched"), ("dispatched", "polling"), ("dispatched", "succeeded"), ("dispatched", "failed"),
    ("polling", "polling"), ("polling", "succeeded"), ("polling", "failed"), ("failed", "pending"), ("poll_timeout", "pending"),
    ("pending", "cancelled"), ("dispatched", "cancelled"), ("polling", "cancelled"), ("polling", "poll_timeout"),
)


def _fold(status: str, failures: int, applied: int, ignored: int, kinds: Sequence[str],
          max_retries: int) -> tuple[str, int, int, int]:
    for kind in kinds:
        if status in TERMINAL:
            ignored += 1
            continue
        if kind == RESULT_SUCCESS:
            status, applied = "succeeded", applied + 1
        elif kind == RESULT_FAILURE:
            failures += 1
            status = "failed" if failures > max_retries else "retry_pending"
            applied += 1
        elif kind == RESULT_POLLING:
            status, applied = "polling", applied + 1
    return status, failures, applied, ignored


def result_state_stream(results: DataFrame, key_col: str, order_cols: Sequence[str], kind_col: str,
                        max_retries: int = 2) -> DataFrame:
    """T9/T10 on a stream: per step key, fold results into the step status."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            status, failures, applied, ignored = state.get
        else:
            status, failures, applied, ignored = "dispatched", 0, 0, 0
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(list(order_cols), kind="mergesort")
        status, failures, applied, ignored = _fold(status, int(failures), int(applied), int(ignored),
                                                   batch[kind_col].tolist(), max_retries)
        state.update((status, failures, applied, ignored))
        yield pd.DataFrame({"step_key": [str(key[0])], "final_status": [status], "failures": [failures],
                            "n_applied": [applied], "n_ignored": [ignored]})

    src = results.select(F.col(key_col).cast("string").alias(key_col), *order_cols, kind_col)
    return src.groupBy(key_col).applyInPandasWithState(
        step, RESULT_OUT, RESULT_STATE, "update", GroupStateTimeout.NoTimeout)


def result_state_batches(results: DataFrame, target: VersionedTable, key_col: str, order_cols: Sequence[str],
                         kind_col: str, checkpoint: str, max_retries: int | Column = 2) -> VersionedTable:
    """T9/T10 on a stream without a per-key Python group: each micro-batch
    continues the stored states of its steps by the ordered fold of
    :mod:`inventa.operators.result_fold` and is upserted (sequence = batch id).
    ``max_retries`` may be a column of the results (a step's own limit).  A
    replayed batch id that was already committed is skipped, so state counts
    never double."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        apply_result_batch(target, batch, batch_id, key_col, order_cols, kind_col, max_retries)

    q = (results.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return target


def apply_result_batch(target: VersionedTable, batch: DataFrame, batch_id: int, key_col: str,
                       order_cols: Sequence[str], kind_col: str, max_retries: int | Column = 2) -> bool:
    """One micro-batch of :func:`result_state_batches`; returns False when
    the batch id was already committed (replay after a failure)."""
    from inventa.operators.result_fold import fold_results
    from inventa.sources.tables import bucket_of
    latest = target.latest_version()
    if latest and int(target._bucket_map(latest).get("properties", {}).get("last_batch_id", -1)) >= batch_id:
        return False
    batch = batch.withColumn(key_col, F.col(key_col).cast("string"))
    state = None
    if latest:
        # only the buckets of the steps in this batch are read (≤ `buckets` ids come back)
        touched = [r[0] for r in batch.select(bucket_of([key_col], target.buckets)).distinct().collect()]
        state = target.read(buckets=touched).drop("_batch") if touched else None
    new = fold_results(batch, [key_col], order_cols, kind_col, max_retries, state)
    target.properties["last_batch_id"] = str(batch_id)
    target.upsert(new.withColumn("_batch", F.lit(batch_id)))
    return True


RUN_STATE = "started_ms long, tasks string"
RUN_OUT = "run_id string, run_status string, n_tasks int, n_timed_out int, finished_by string"
BAD = ("failed", "timeout", "dispatch_failed")
OPEN = ("pending", "running", "dispatched")


def _run_status(statuses: list[str]) -> str:
    bad = [s in BAD for s in statuses]
    return "failed" if bad and all(bad) else "completed_with_errors" if any(bad) else "completed"


def run_tracker_stream(task_events: DataFrame, run_col: str = "run_id", task_col: str = "task_id",
                       status_col: str = "status", ts_col: str = "ts", timeout_hours: int = 8,
                       watermark: str = "10 minutes") -> DataFrame:
    """T18 on a stream: per run, the latest status of each task (a run has
    tenants × containers tasks, so its state is small); when every task is
    finished the run is finalised (A11); when the event-time watermark
    passes start + ``timeout_hours`` first, open tasks become ``timeout``
    and the run is finalised by the timer."""

    def track(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json as _json
        if state.hasTimedOut:
            started, tasks = state.get
            tasks = _json.loads(tasks)
            timed = [t for t, s in tasks.items() if s in OPEN]
            for t in timed:
                tasks[t] = "timeout"
            state.remove()
            yield pd.DataFrame({"run_id": [str(key[0])], "run_status": [_run_status(list(tasks.values()))],
                                "n_tasks": [len(tasks)], "n_timed_out": [len(timed)], "finished_by": ["timer"]})
            return
        started, tasks = (state.get[0], _json.loads(state.get[1])) if state.exists else (None, {})
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values([ts_col, task_col], kind="mergesort")
        for task, status in zip(batch[task_col], batch[status_col]):
            tasks[str(task)] = status
        first_ms = int(pd.Timestamp(batch[ts_col].min()).value // 1_000_000)
        started = first_ms if started is None else min(int(started), first_ms)
        if tasks and all(s not in OPEN for s in tasks.values()):
            state.remove()
            yield pd.DataFrame({"run_id": [str(key[0])], "run_status": [_run_status(list(tasks.values()))],
                                "n_tasks": [len(tasks)], "n_timed_out": [0], "finished_by": ["tasks"]})
            return
        state.update((started, _json.dumps(tasks)))
        state.setTimeoutTimestamp(started + timeout_hours * 3_600_000)

    src = (task_events.withWatermark(ts_col, watermark)
           .select(F.col(run_col).cast("string").alias(run_col), F.col(task_col).cast("string").alias(task_col),
                   status_col, ts_col))
    return src.groupBy(run_col).applyInPandasWithState(track, RUN_OUT, RUN_STATE, "append",
                                                       GroupStateTimeout.EventTimeTimeout)


def checkin_stream(spark: SparkSession, checkins: DataFrame, target: VersionedTable, keys: Sequence[str],
                   ts_col: str, value_col: str, checkpoint: str) -> VersionedTable:
    """One availableNow update of the check-in status table:
    ``check_in_count`` adds up, ``last_check_in``/``last_value`` follow the
    newest check-in (of equal times, the greatest value).  The table records
    the last batch it holds: a batch replayed after a crash between the table's
    commit and the checkpoint's is skipped, so nothing counts twice."""
    keys = list(keys)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        latest = target.latest_version()
        if latest and int(target._bucket_map(latest).get("properties", {}).get("last_batch_id", -1)) >= batch_id:
            return
        target.properties["last_batch_id"] = str(batch_id)
        newest = F.max(F.struct(F.col(ts_col).alias("t"), F.col(value_col).alias("v")))
        agg = (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("check_in_count"), newest.alias("_n"))
               .select(*keys, "check_in_count", F.col("_n.t").alias("last_check_in"), F.col("_n.v").alias("last_value")))

        def combine(cur: DataFrame, chg: DataFrame) -> DataFrame:
            # joins keyed by the (counted) change set: stored rows that did
            # not change stream through untouched; matched ones add up
            from inventa.sources.tables import BROADCAST_ROW_LIMIT, BUCKET_COL
            small = F.broadcast if target._last_change_rows <= BROADCAST_ROW_LIMIT else (lambda d: d)
            cols = ["check_in_count", "last_check_in", "last_value"]
            c = chg.select(*keys, *[F.col(x).alias(f"_n_{x}") for x in cols])
            matched = cur.select(*keys, *cols).join(small(c), keys, "inner")
            newer = (F.struct(F.col("_n_last_check_in"), F.col("_n_last_value"))
                     >= F.struct(F.col("last_check_in"), F.col("last_value")))
            updated = matched.select(
                *keys, (F.col("check_in_count") + F.col("_n_check_in_count")).alias("check_in_count"),
                F.greatest("last_check_in", "_n_last_check_in").alias("last_check_in"),
                F.when(newer, F.col("_n_last_value")).otherwise(F.col("last_value")).alias("last_value"))
            fresh = chg.select(*keys, *cols).join(updated.select(*keys), keys, "left_anti")
            kept = cur.drop(BUCKET_COL).join(small(chg.select(*keys)), keys, "left_anti")
            return kept.select(*keys, *cols).unionByName(updated).unionByName(fresh)
        target.merge(agg, combine, cluster_output=False)

    q = (checkins.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return target


def transition_rows(current: DataFrame, events: DataFrame, key: str, status_col: str = "status",
                    to_col: str = "to_status") -> DataFrame:
    """Apply requested transitions only where (current → requested) is
    allowed (compare-and-set); others are returned with ``applied=false``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in STEP_TRANSITIONS])
    x = events.join(current.select(key, F.col(status_col).alias("from_status")), key, "left")
    ok = F.exists(pairs, lambda p: (p.f == F.col("from_status")) & (p.t == F.col(to_col)))
    return x.withColumn("applied", F.coalesce(ok, F.lit(False)))
