"""Keyed stream processors: T10 (``transformWithState``) and T18
(``transformWithStateInPandas``).

State lives in the RocksDB state store as single values, lists and map entries;
event-time timers do the rest.
:func:`use_rocksdb` sets the provider on the session, as Spark needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inventa.operators.result_fold import ENDED, MOST_RETRIES
from inventa.operators.results import RESULT_FAILURE, RESULT_POLLING, RESULT_SUCCESS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Task statuses of a run.
BAD = ("failed", "timeout", "dispatch_failed")
OPEN = ("pending", "running", "dispatched")

STEP_STATE = "status string, failures int, n_applied long, n_ignored long, clear_at long, due_at long"
NEW_STEP = ("dispatched", 0, 0, 0, None, None)
STEP_OUT = "step_key string, status string, failures int, n_applied long, n_ignored long, folded_to_ms long"
RUN_STATE = "started_ms long, n_tasks int, n_open int, n_bad int"
RUN_OUT = "run_id string, run_status string, n_tasks int, n_timed_out int, finished_by string"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors run on the RocksDB state store only."""
    spark.conf.set(PROVIDER, ROCKSDB)


class OrderedResults(StatefulProcessor):
    """Results wait until the watermark has passed the end of their slice of
    event time; the slices it has passed are then folded in order, so neither the
    order of arrival nor the cut into micro-batches changes the result.

    A step has one timer, at the end of its earliest waiting slice, and one list
    of waiting results, to which a call adds a block: the calls to the state
    follow the steps that a micro-batch touches, not their slices."""

    def __init__(self, slice_ms: int, keep_ms: int | None, tie_type: str):
        self.slice_ms, self.keep_ms, self.tie_type = slice_ms, keep_ms, tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step = handle.getValueState("step", STEP_STATE)
        self.waiting = handle.getListState("results",
                                           f"at array<long>, known array<boolean>, tie array<{self.tie_type}>, kind array<string>, most array<int>")

    def _end(self, us: int) -> int:
        return (us // (1000 * self.slice_ms) + 1) * self.slice_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        block = [list(c) for c in zip(*((r.us, r.known, r.tie, r.kind, r.most) for r in rows))]
        if block:
            self.waiting.appendValue(tuple(block))
            *state, due_at = self.step.get() or NEW_STEP
            end = self._end(min(block[0]))
            if due_at is None or end < due_at:
                self.handle.registerTimer(end)
                self.step.update((*state, end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        status, failures, applied, ignored, clear_at, due_at = self.step.get() or NEW_STEP
        if due_at is None or due_at > now:
            if clear_at is not None and clear_at <= expiredTimerInfo.getExpiryTimeInMs():
                if due_at is None:
                    self.step.clear()
                else:
                    self.step.update((*NEW_STEP[:-1], due_at))
            return
        due, later = [], []
        for block in self.waiting.get():
            for result in zip(*block):
                (due if self._end(result[0]) <= now else later).append(result)
        due.sort(key=lambda r: r[:4])
        for end, slice_ in groupby(due, key=lambda r: self._end(r[0])):
            if clear_at is not None and clear_at < end:
                status, failures, applied, ignored, clear_at, _ = NEW_STEP
            for *_, kind, most in slice_:
                if status in ENDED:
                    ignored += 1
                elif kind == RESULT_SUCCESS:
                    status, applied = "succeeded", applied + 1
                elif kind == RESULT_FAILURE:
                    failures, applied = failures + 1, applied + 1
                    status = "failed" if failures > most else "retry_pending"
                elif kind == RESULT_POLLING:
                    status, applied = "polling", applied + 1
            if status in ENDED and self.keep_ms is not None:
                clear_at = end + self.keep_ms
            yield Row(step_key=key[0], status=status, failures=failures, n_applied=applied, n_ignored=ignored, folded_to_ms=end)
        due_at = None
        if later:
            due_at = self._end(min(r[0] for r in later))
            self.handle.registerTimer(due_at)
            self.waiting.put([tuple(list(c) for c in zip(*later))])
        else:
            self.waiting.clear()
        if clear_at is not None:
            self.handle.registerTimer(clear_at)
        self.step.update((status, failures, applied, ignored, clear_at, due_at))


def ordered_results_stream(results: DataFrame, key_col: str, ts_col: str, tie_col: str, kind_col: str,
                           limit: Column | int = 2, watermark: str = "10 minutes", slice_ms: int = 60_000,
                           keep_ms: int | None = None) -> DataFrame:
    """T10 on a stream, exact in event order: an append stream with a step's state
    after each folded slice (``folded_to_ms``: end of its latest slice; the row of
    the greatest is the current state).  With all results in, it equals
    :func:`inventa.operators.result_fold.fold_results` over them.

    ``limit`` is the step's own retry limit (a column of the results or a number, 0
    to 60; null: 2).  Equal times are ordered by ``tie_col`` (a whole number or a text), null
    first, then by kind.  Results later than
    the watermark allows are dropped by Spark and counted in the query's progress;
    rows without a time have no place in the order and are left out.  Results wait
    until the watermark passes them, so the last ones appear when newer ones come.
    An ended step's state is kept, or cleared ``keep_ms`` of event time after its
    end.  A call handles one step's waiting results: a step with most of all
    results is better served by ``reducers.result_state_batches``."""
    use_rocksdb(results.sparkSession)
    number = isinstance(results.schema[tie_col].dataType, T.IntegralType)
    tie_type = "long" if number else "string"
    most = F.coalesce(limit if isinstance(limit, Column) else F.lit(limit), F.lit(2))
    src = (results.where(F.col(ts_col).isNotNull())
           .select(F.col(key_col).cast("string").alias("step_key"), F.col(ts_col).cast("timestamp").alias("ts"),
                   F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us"), F.col(tie_col).isNotNull().alias("known"),
                   F.coalesce(F.col(tie_col).cast(tie_type), F.lit(0 if number else "").cast(tie_type)).alias("tie"),
                   F.coalesce(F.col(kind_col), F.lit("")).alias("kind"),
                   F.least(F.greatest(most, F.lit(0)), F.lit(MOST_RETRIES)).cast("int").alias("most"))
           .withWatermark("ts", watermark))
    return src.groupBy("step_key").transformWithState(
        OrderedResults(slice_ms, keep_ms, tie_type), outputStructType=STEP_OUT, outputMode="append", timeMode="EventTime")


def run_status(n_tasks: int, n_bad: int) -> str:
    return "completed" if n_bad == 0 else "failed" if n_bad == n_tasks else "completed_with_errors"


class RunTasks(StatefulProcessor):
    """One map entry per task and four numbers per run."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE)
        self.tasks = handle.getMapState("tasks", "task_id string", "status string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, n_tasks, n_open, n_bad = self.run.get() if self.run.exists() else (None, 0, 0, 0)
        started = before
        for pdf in rows:
            first = int(pdf["us"].min()) // 1000
            started = first if started is None else min(started, first)
            pdf = pdf.assign(done=~pdf["status"].isin(OPEN)).sort_values(["us", "done", "status"], kind="mergesort")
            last = pdf.drop_duplicates("task", keep="last")
            for task, status, at in zip(last["task"], last["status"], last["us"]):
                old = self.tasks.getValue((task,)) if self.tasks.containsKey((task,)) else None
                if old is not None:
                    if (old[1], old[0] not in OPEN, old[0]) > (int(at), status not in OPEN, status):
                        continue
                    n_open, n_bad = n_open - (old[0] in OPEN), n_bad - (old[0] in BAD)
                else:
                    n_tasks += 1
                n_open, n_bad = n_open + (status in OPEN), n_bad + (status in BAD)
                self.tasks.updateValue((task,), (status, int(at)))
        if n_open == 0:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_ms)
            yield self._finish(key, n_tasks, n_bad, 0, "tasks")
            return
        if before != started:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_ms)
            self.handle.registerTimer(started + self.timeout_ms)
        self.run.update((started, n_tasks, n_open, n_bad))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            _, n_tasks, n_open, n_bad = self.run.get()
            yield self._finish(key, n_tasks, n_bad + n_open, n_open, "timer")

    def _finish(self, key, n_tasks: int, n_bad: int, n_timed_out: int, by: str) -> pd.DataFrame:
        self.run.clear()
        self.tasks.clear()
        return pd.DataFrame({"run_id": [key[0]], "run_status": [run_status(n_tasks, n_bad)], "n_tasks": [n_tasks],
                             "n_timed_out": [n_timed_out], "finished_by": [by]})


def run_tasks_stream(task_events: DataFrame, run_col: str = "run_id", task_col: str = "task_id", status_col: str = "status",
                     ts_col: str = "ts", timeout_hours: int = 8, watermark: str = "10 minutes") -> DataFrame:
    """T18 on a stream: per run the latest status of each task by event time (at
    equal times a finished one wins, then the greater).  A run is finalised (A11) when
    every task is finished, or by the timer when the watermark passes its first
    event + ``timeout_hours``: open tasks then count as ``timeout``.  Rows without a
    run, task, status or time are left out.  A task event after the end begins
    the run anew."""
    use_rocksdb(task_events.sparkSession)
    src = (task_events.dropna(subset=[run_col, task_col, status_col, ts_col])
           .select(F.col(run_col).cast("string").alias("run"), F.col(task_col).cast("string").alias("task"),
                   F.col(status_col).alias("status"), F.col(ts_col).cast("timestamp").alias("ts"),
                   F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us"))
           .withWatermark("ts", watermark))
    return src.groupBy("run").transformWithStateInPandas(
        RunTasks(timeout_hours * 3_600_000), outputStructType=RUN_OUT, outputMode="append", timeMode="EventTime")
