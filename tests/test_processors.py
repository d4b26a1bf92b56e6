"""Ordered results and run tasks on streams, against plain folds."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inventa.operators.result_fold import fold_results
from inventa.streaming.processors import PROVIDER, OrderedResults, ordered_results_stream, run_tasks_stream

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def provider(spark):
    old = spark.conf.get(PROVIDER, None)
    yield
    spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def _parts(spark, root, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/p={i}")
        time.sleep(0.05)


def _run(stream, root, tag):
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/{tag}")
         .option("checkpointLocation", f"{root}/ck_{tag}").trigger(availableNow=True).start())
    q.awaitTermination()


RESULTS = "step string, ts timestamp, id long, kind string, most int"


def _read(spark, root, schema):
    return spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in").drop("p")


def test_results_out_of_order_equal_the_batch_fold(spark, tmp_root):
    rnd = random.Random(3)
    kinds = ["failure", "failure", "polling", "heartbeat", "success"]
    rows = [(f"s{rnd.randrange(12)}", T0 + dt.timedelta(seconds=rnd.randrange(3600)), i, rnd.choice(kinds), None)
            for i in range(200)]
    rows += rows[:5]  # repeated rows are results of their own
    rows = [(s, t, i, k, {"s0": 0, "s1": 5, "s2": None}.get(s, 1)) for s, t, i, k, _ in rows]
    rnd.shuffle(rows)
    close = [("closing", T0 + dt.timedelta(hours=9), 0, "polling", 1)]
    _parts(spark, f"{tmp_root}/in", [rows[:90], rows[90:150]], RESULTS)

    def step():
        _run(ordered_results_stream(_read(spark, tmp_root, RESULTS), "step", "ts", "id", "kind", F.col("most"),
                                    watermark="2 hours", slice_ms=600_000), tmp_root, "out")

    step()
    for i, part in enumerate([rows[150:], close, [("closing", T0 + dt.timedelta(hours=10), 1, "polling", 1)]]):
        spark.createDataFrame(part, RESULTS).coalesce(1).write.parquet(f"{tmp_root}/in/p={i + 2}")
        step()  # the stream goes on from its checkpoint
    out = spark.read.parquet(f"{tmp_root}/out").where("step_key <> 'closing'")
    got = out.groupBy("step_key").agg(F.max_by(F.struct("status", "failures", "n_applied", "n_ignored"), "folded_to_ms").alias("s"))
    batch = fold_results(spark.createDataFrame(rows, RESULTS), ["step"], ["ts", "id"], "kind", F.col("most"))
    want = {r["step"]: (r["status"], r["failures"], r["n_applied"], r["n_ignored"]) for r in batch.collect()}
    assert {r["step_key"]: tuple(r["s"]) for r in got.collect()} == want
    assert len(want) == 12


def test_runs_finish_by_tasks_or_timer_and_late_statuses_lose(spark, tmp_root):
    h = lambda n: T0 + dt.timedelta(hours=n)
    schema = "run_id string, task_id string, status string, ts timestamp"
    parts = [
        [("A", "1", "running", h(1)), ("A", "2", "running", h(0)), ("B", "1", "running", h(0)), ("B", "2", "failed", h(1)),
         ("D", "1", "running", h(0)), (None, "1", "running", h(0)), ("E", None, "running", h(0))],
        # A/1 finished at 2; its older status comes after it
        [("A", "1", "completed", h(2)), ("D", "1", "running", h(1)), ("D", "1", "completed", h(1))],
        [("A", "1", "running", h(1.95)), ("A", "2", "completed", h(2))],
        [("C", "1", "running", h(11))],
        [("C", "2", "running", h(12))],
    ]
    _parts(spark, f"{tmp_root}/in", parts, schema)
    _run(run_tasks_stream(_read(spark, tmp_root, schema)), tmp_root, "out")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_root}/out").collect())
    assert got == [("A", "completed", 2, 0, "tasks"), ("B", "failed", 2, 1, "timer"), ("D", "completed", 1, 0, "tasks")]


class _Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class _List(_Value):
    def get(self):
        self.calls.append("get")
        return iter(self.value or [])

    def appendValue(self, value):
        self.calls.append("appendValue")
        self.value = [*(self.value or []), value]

    def put(self, values):
        self.update(list(values))


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, name, schema):
        return _Value(self.calls)

    def getListState(self, name, schema):
        return _List(self.calls)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


class _At:
    def __init__(self, watermark, expiry):
        self.watermark, self.expiry = watermark, expiry

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.expiry


def test_calls_to_the_state_do_not_follow_the_slices_of_a_step():
    """500 slices in two calls wait and are folded with a dozen calls; what the
    watermark has not passed waits on under a timer of its own."""
    handle, processor = _Handle(), OrderedResults(1000, None, "long")
    processor.init(handle)
    results = [Row(us=i * 1_000_000, known=True, tie=i, kind="polling", most=2) for i in range(500)]
    random.Random(1).shuffle(results)
    for part in (results[:250], results[250:]):
        assert list(processor.handleInputRows(("s",), iter(part), _At(0, None))) == []
    assert min(handle.timers) == 1000
    out = list(processor.handleExpiredTimer(("s",), _At(400_000, None), _At(None, 1000)))
    assert [r["folded_to_ms"] for r in out] == [1000 * (i + 1) for i in range(400)]
    assert [r["n_applied"] for r in out] == list(range(1, 401))
    assert 401_000 in handle.timers
    assert list(processor.handleExpiredTimer(("s",), _At(400_000, None), _At(None, 400_000))) == []  # an older timer
    out = list(processor.handleExpiredTimer(("s",), _At(600_000, None), _At(None, 401_000)))
    assert len(out) == 100 and out[-1]["n_applied"] == 500
    assert len(handle.calls) <= 20


def test_an_ended_step_is_cleared_between_slices_that_one_call_folds():
    handle, processor = _Handle(), OrderedResults(1000, 5000, "long")
    processor.init(handle)
    results = [Row(us=us, known=True, tie=0, kind=kind, most=0)
               for us, kind in ((500_000, "failure"), (1_500_000, "success"), (9_500_000, "polling"))]
    list(processor.handleInputRows(("s",), iter(results), _At(0, None)))
    out = list(processor.handleExpiredTimer(("s",), _At(20_000, None), _At(None, 1000)))
    assert [(r["status"], r["n_applied"], r["n_ignored"]) for r in out] == [("failed", 1, 0), ("failed", 1, 1), ("polling", 1, 0)]
