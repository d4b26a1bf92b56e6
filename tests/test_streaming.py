"""Landing, bronze and silver streams; versioned tables; stateful reducers."""

import json
import os
import time

from pyspark.sql import functions as F

from inventa.operators.results import reduce_results
from inventa.sources.landing import landing_glob, read_landing, read_legacy_wrapper
from inventa.sources.tables import VersionedTable
from inventa.specs import BRONZE, SILVER, BronzeSpec, SilverSpec, snake_case
from inventa.streaming.bronze import read_bronze, run_bronze
from inventa.streaming.reducers import checkin_stream, result_state_stream, transition_rows
from inventa.streaming.silver import run_silver


def write_jsonl(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_registry_counts():
    assert len(BRONZE) == 39 and len(SILVER) == 39
    assert snake_case("userPrincipalName") == "user_principal_name"
    assert snake_case("@odata.type") == "odata_type"
    assert snake_case("ExchangeGuid") == "exchange_guid"


def test_empty_landing_is_zero_rows(spark, tmp_root):
    df = read_landing(spark, tmp_root, "nothing_here", "id string", streaming=False)
    assert df.count() == 0


def test_phase_globs_and_tenant_key(spark, tmp_root):
    write_jsonl(f"{tmp_root}/ent/t1/2024-01-01/ent_r1.jsonl", [{"id": "a"}, {"id": "b"}])
    write_jsonl(f"{tmp_root}/ent/t2/2024-01-02/ent_r1.jsonl", [{"id": "c"}])
    write_jsonl(f"{tmp_root}/ent/t1/2024-01-01/members/chunk-000_r1.jsonl", [{"id": "m"}])
    write_jsonl(f"{tmp_root}/ent/t1/2024-01-01/other_r1.txt", [{"id": "x"}])
    write_jsonl(f"{tmp_root}/ent/misc/latest/ent_r1.jsonl", [{"id": "z"}])
    p1 = read_landing(spark, tmp_root, "ent", "id string", streaming=False)
    got = sorted((r["id"], r["_tenant_key"]) for r in p1.collect())
    assert got == [("a", "t1"), ("b", "t1"), ("c", "t2"), ("z", None)]
    p2 = read_landing(spark, tmp_root, "ent", "id string", detail_type="members", streaming=False)
    assert [r["id"] for r in p2.collect()] == ["m"]
    assert landing_glob("/r", "e", "d") == "/r/e/*/*/d/"


def test_run_history_has_no_tenant(spark, tmp_root):
    write_jsonl(f"{tmp_root}/_orchestrator/runs/2026-01-01/runs_r1.jsonl", [{"run_id": "r1", "status": "completed"}])
    spec = BRONZE["orchestrator_runs"]
    df = read_landing(spark, tmp_root, spec.entity, spec.schema, streaming=False, tenant_from_dir=False,
                      levels=spec.levels)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["_tenant_key"] is None and rows[0]["run_id"] == "r1"


def test_legacy_wrapper(spark, tmp_root):
    p = f"{tmp_root}/legacy/t9/2024-01-01/x.json"
    os.makedirs(os.path.dirname(p))
    with open(p, "w") as f:
        json.dump({"tenant_name": None, "run_id": "r", "data": [{"id": "1"}, {"id": "2"}]}, f, indent=2)
    df = read_legacy_wrapper(spark, f"{tmp_root}/legacy/*/*/", spark.read.schema("id string").json(
        spark.sparkContext.emptyRDD()).schema)
    assert sorted((r["id"], r["_tenant_key"]) for r in df.collect()) == [("1", "t9"), ("2", "t9")]


def _land_and_upsert(spark, root, rows, run, day):
    write_jsonl(f"{root}/landing/users/t1/{day}/users_{run}.jsonl", rows)
    spec = BronzeSpec("users", "users", ddl="id string, displayName string, mail string")
    totals = run_bronze(spark, f"{root}/landing", f"{root}/bronze", spec, f"{root}/ckpt")
    sspec = SilverSpec("users", "users", ("id",))
    t = run_silver(spark, read_bronze(spark, f"{root}/bronze", spec, streaming=True), f"{root}/silver",
                   sspec, f"{root}/ckpt")
    return t, totals


def test_bronze_silver_replay_and_update(spark, tmp_root):
    t, totals = _land_and_upsert(spark, tmp_root, [{"id": "1", "displayName": "A", "mail": "a@x"},
                                                   {"id": "2", "displayName": "B"}], "r1", "2024-01-01")
    assert totals == {"rows": 2, "passed": 2, "failed": 0}
    v1 = {r["id"]: r["display_name"] for r in t.read().collect()}
    assert v1 == {"1": "A", "2": "B"}
    # re-landing identical content under a new run id leaves the result unchanged (T4)
    t, _ = _land_and_upsert(spark, tmp_root, [{"id": "1", "displayName": "A", "mail": "a@x"},
                                              {"id": "2", "displayName": "B"}], "r1b", "2024-01-01")
    assert {r["id"]: r["display_name"] for r in t.read().collect()} == v1
    # a later run changes one key; the absent key stays (T5)
    t, _ = _land_and_upsert(spark, tmp_root, [{"id": "1", "displayName": "A2"}], "r2", "2024-01-02")
    now = {r["id"]: (r["display_name"], r["tenant_key"], r["_scd_key"]) for r in t.read().collect()}
    assert now == {"1": ("A2", "t1", "t1_1"), "2": ("B", "t1", "t1_2")}
    # time travel: version 1 still has the first state
    assert {r["id"]: r["display_name"] for r in t.read(version=1).collect()} == v1
    assert len(t.history()) >= 3


def test_versioned_table_vacuum_keeps_readable(spark, tmp_root):
    t = VersionedTable(spark, f"{tmp_root}/vt", ["k"], [F.col("s")], buckets=4)
    for s in range(4):
        t.upsert(spark.createDataFrame([(k, s) for k in range(s * 3, s * 3 + 5)], "k int, s int"))
    before = sorted(tuple(r) for r in t.read().collect())
    t.vacuum(keep_versions=1)
    assert sorted(tuple(r) for r in t.read().collect()) == before
    assert t.versions() == [4]


def test_version_as_of(spark, tmp_root):
    t = VersionedTable(spark, f"{tmp_root}/vt2", ["k"], [F.col("s")], buckets=2)
    t.upsert(spark.createDataFrame([(1, 1)], "k int, s int"))
    mid = time.time()
    time.sleep(0.05)
    t.upsert(spark.createDataFrame([(1, 2)], "k int, s int"))
    assert t.version_as_of(mid) == 1


def test_result_state_stream_matches_batch(spark, tmp_root):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = (F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure")
             .when(F.col("event_type") == "view", "polling").otherwise("heartbeat"))
    src = e.select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_id", kind.alias("kind"))
    src.write.parquet(f"{tmp_root}/results")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_root}/results")
    out = result_state_stream(stream, "user_id", ["ts", "event_id"], "kind")
    q = (out.writeStream.outputMode("update").format("memory").queryName("reducer_out")
         .option("checkpointLocation", f"{tmp_root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["step_key"]: (r["final_status"], r["n_applied"], r["n_ignored"])
           for r in spark.sql("SELECT * FROM reducer_out").collect()}
    want = {r["user_id"]: (r["final_status"], r["n_applied"], r["n_ignored"])
            for r in reduce_results(src, ["user_id"], ["ts", "event_id"], "kind").collect()}
    assert got == want


def test_checkin_stream_additive(spark, tmp_root):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "ts", "value")
    e.filter(F.col("ts") < "2024-01-15").write.parquet(f"{tmp_root}/ci/p=a")
    t = VersionedTable(spark, f"{tmp_root}/status", ["user_id", "event_type"], [F.col("last_check_in")], buckets=4)
    stream = spark.readStream.schema(e.schema.add("p", "string")).parquet(f"{tmp_root}/ci")
    checkin_stream(spark, stream, t, ["user_id", "event_type"], "ts", "value", f"{tmp_root}/ci_ck")
    e.filter(F.col("ts") >= "2024-01-15").write.parquet(f"{tmp_root}/ci/p=b")
    stream = spark.readStream.schema(e.schema.add("p", "string")).parquet(f"{tmp_root}/ci")
    checkin_stream(spark, stream, t, ["user_id", "event_type"], "ts", "value", f"{tmp_root}/ci_ck")
    got = {(r["user_id"], r["event_type"]): (r["check_in_count"], r["last_value"]) for r in t.read().collect()}
    want = {(r["user_id"], r["event_type"]): (r["n"], r["v"]) for r in e.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("value", "ts").alias("v")).collect()}
    assert got == want


def test_transition_rows(spark):
    cur = spark.createDataFrame([("s1", "dispatched"), ("s2", "succeeded")], "step string, status string")
    ev = spark.createDataFrame([("s1", "succeeded"), ("s2", "failed"), ("s3", "dispatched")], "step string, to_status string")
    out = {r["step"]: r["applied"] for r in transition_rows(cur, ev, "step").collect()}
    assert out == {"s1": True, "s2": False, "s3": False}


def test_compact_keeps_rows(spark, tmp_root):
    t = VersionedTable(spark, f"{tmp_root}/vt3", ["k"], [F.col("s")], buckets=4)
    t.upsert(spark.range(0, 500).selectExpr("id AS k", "0 AS s").repartition(5))
    t.upsert(spark.range(250, 750).selectExpr("id AS k", "1 AS s").repartition(7))
    before = sorted(tuple(r) for r in t.read().collect())
    assert len(before) == 750 and sum(1 for r in before if r[1] == 1) == 500
    t.compact()
    assert sorted(tuple(r) for r in t.read().collect()) == before


def test_result_state_batches_matches_batch_reducer(spark, tmp_root):
    from inventa.streaming.reducers import apply_result_batch, result_state_batches
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = (F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure")
             .when(F.col("event_type") == "view", "polling").otherwise("heartbeat"))
    src = e.select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_id", kind.alias("kind"))
    # three time slices, one file each, arriving in time order
    for i, (lo, hi) in enumerate((("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-20"), ("2024-01-20", "2024-02-01"))):
        src.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.parquet(f"{tmp_root}/res/p={i}")
        time.sleep(0.05)
    t = VersionedTable(spark, f"{tmp_root}/state", ["user_id"], [F.col("_batch")], buckets=4)
    stream = (spark.readStream.schema(src.schema.add("p", "integer")).option("maxFilesPerTrigger", 1)
              .parquet(f"{tmp_root}/res"))
    result_state_batches(stream.drop("p"), t, "user_id", ["ts", "event_id"], "kind", f"{tmp_root}/ck")
    got = {r["user_id"]: (r["status"], r["n_applied"], r["n_ignored"]) for r in t.read().collect()}
    want = {r["user_id"]: (r["final_status"], r["n_applied"], r["n_ignored"])
            for r in reduce_results(src, ["user_id"], ["ts", "event_id"], "kind").collect()}
    assert got == want
    assert len(t.versions()) == 3
    # a replayed batch id is skipped
    assert apply_result_batch(t, src, 2, "user_id", ["ts", "event_id"], "kind") is False


def test_checkin_batch_replayed_after_a_crash_counts_once(spark, tmp_root):
    import glob
    import os

    from inventa.sources.tables import VersionedTable
    from inventa.streaming.reducers import checkin_stream
    rows = spark.createDataFrame([("u1", 10, 5.0), ("u1", 10, 7.0), ("u2", 3, 1.0)], "k string, ts int, v double")
    rows.coalesce(1).write.parquet(f"{tmp_root}/in")
    t = VersionedTable(spark, f"{tmp_root}/t", ["k"], [F.col("last_check_in")], buckets=2)
    for _ in range(2):
        checkin_stream(spark, spark.readStream.schema(rows.schema).parquet(f"{tmp_root}/in"), t, ["k"], "ts", "v", f"{tmp_root}/ck")
        # as if the driver had died before the stream noted the batch as done
        for f in glob.glob(f"{tmp_root}/ck/commits/*") + glob.glob(f"{tmp_root}/ck/commits/.*.crc"):
            os.remove(f)
    got = {r["k"]: (r["check_in_count"], r["last_check_in"], r["last_value"]) for r in t.read().collect()}
    assert got == {"u1": (2, 10, 7.0), "u2": (1, 3, 1.0)}


def test_first_version_is_written_once_and_buckets_are_dealt_by_number(spark, tmp_root):
    """The first rows go straight to the version's folder; later dealt rows of a
    bucket share a task with no other bucket."""
    import io
    from contextlib import redirect_stdout

    from pyspark.sql import functions as F

    from inventa.sources import tables

    t = tables.VersionedTable(spark, f"{tmp_root}/t", ["k"], ["s"], buckets=5)
    rows = spark.range(0, 400).select((F.col("id") % 150).alias("k"), F.col("id").alias("s"), F.col("id").cast("string").alias("v"))
    t.merge = None  # not used for the first version
    assert t.upsert(rows.limit(0)) == 0 and t.versions() == []
    assert t.upsert(rows) == 1
    want = {k: max(i for i in range(400) if i % 150 == k) for k in range(150)}
    assert {r["k"]: (r["s"], r["v"]) for r in t.read().collect()} == {k: (s, str(s)) for k, s in want.items()}
    assert t.read().columns == ["k", "s", "v"]
    del t.merge
    assert t.upsert(rows.where("k < 3").withColumn("s", F.col("s") + 1000)) == 2
    assert {r["k"]: r["s"] for r in t.read().collect()} == {k: s + 1000 * (k < 3) for k, s in want.items()}
    dealt = t._dealt(t.read().withColumn(tables.BUCKET_COL, tables.bucket_of(["k"], 5)), 3 * tables.ROWS_PER_FILE)
    assert dealt.rdd.getNumPartitions() == 15
    per = dealt.groupBy(F.spark_partition_id()).agg(F.countDistinct(tables.BUCKET_COL).alias("n")).collect()
    assert per and all(r["n"] == 1 for r in per)
    with redirect_stdout(io.StringIO()):
        dealt.explain()


def _rows_per_task(lines):
    """Most rows that a task wrote to a file."""
    return max(lines.groupBy(F.input_file_name()).count().collect(), key=lambda r: r[1])[1]


def test_tasks_follow_rows_not_bytes(spark, tmp_root, monkeypatch):
    """Rows that compress well: landing, bronze and silver give a task a bounded
    number of them, in the first version and in a later one, and leave the
    session as it was."""
    from inventa import session
    from inventa.sources import tables
    from inventa.sources.landing import write_landing
    from inventa.streaming import bronze
    from inventa.streaming.silver_views import read_silver, run_pipeline

    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(bronze, "ROWS_PER_TASK", 500)
    seen = []

    def spy(df, keys, order_by):
        seen.append(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seen.append(max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        return latest(df, keys, order_by)

    latest = tables.latest_per_key
    monkeypatch.setattr(tables, "latest_per_key", spy)
    settings = ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k, None) for k in settings]
    name = "entra_sign_in_logs"
    for run, rows in (("r1", spark.range(10_000)), ("r2", spark.range(8_000, 12_000))):
        write_landing(rows.select(F.col("id").cast("string").alias("id"), F.lit(run).alias("appDisplayName"), F.lit("t1").alias("t"),
                                  F.lit("2024-01-01").alias("d")), f"{tmp_root}/landing", name, "t", "d", run)
        run_pipeline(spark, f"{tmp_root}/landing", f"{tmp_root}/lake", bronze_names=[name], silver_names=["sign_in_logs"])
        assert [spark.conf.get(k, None) for k in settings] == before
    assert _rows_per_task(spark.read.text(f"{tmp_root}/landing/{name}/*/*")) <= 1000
    assert _rows_per_task(spark.read.parquet(f"{tmp_root}/lake/bronze/{name}")) <= 500
    got = read_silver(spark, f"{tmp_root}/lake", "sign_in_logs")
    assert {r[0]: r[1] for r in got.groupBy("app_display_name").count().collect()} == {"r1": 8_000, "r2": 4_000}
    assert got.select("id").distinct().count() == 12_000
    assert seen[0] == "20" and seen[1] <= 1000 and seen[3] <= 1000
