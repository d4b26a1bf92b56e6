"""T18 stream: runs finish when their tasks do, or time out by event time."""

import datetime as dt
import time

from inventa.streaming.reducers import run_tracker_stream


def test_run_tracker_finish_and_timeout(spark, tmp_root):
    t0 = dt.datetime(2026, 1, 1, 0, 0, 0)
    h = lambda n: t0 + dt.timedelta(hours=n)
    first = [("A", "a1", "running", h(0)), ("A", "a2", "running", h(0)), ("B", "b1", "running", h(0)),
             ("B", "b2", "running", h(0)), ("A", "a1", "completed", h(1)), ("A", "a2", "failed", h(2)),
             ("B", "b1", "completed", h(1))]
    later = [("C", "c1", "running", h(10))]  # moves the watermark past B's 8-hour limit
    schema = "run_id string, task_id string, status string, ts timestamp"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_root}/ev/p=1")
    time.sleep(0.05)
    spark.createDataFrame(later, schema).coalesce(1).write.parquet(f"{tmp_root}/ev/p=2")
    stream = (spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1)
              .parquet(f"{tmp_root}/ev").drop("p"))
    q = (run_tracker_stream(stream).writeStream.outputMode("append").format("memory").queryName("runs_out")
         .option("checkpointLocation", f"{tmp_root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["run_id"]: (r["run_status"], r["n_tasks"], r["n_timed_out"], r["finished_by"])
           for r in spark.sql("SELECT * FROM runs_out").collect()}
    assert got["A"] == ("completed_with_errors", 2, 0, "tasks")
    assert got["B"] == ("completed_with_errors", 2, 1, "timer")
    assert "C" not in got
