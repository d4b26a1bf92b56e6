"""DataFrame operators checked against brute force on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from inventa.operators import listing as L
from inventa.operators import members as M
from inventa.operators import phases as PH
from inventa.operators import results as RS
from inventa.operators import runs as R
from inventa.operators.scd import latest_per_key, merge_latest


def test_latest_per_key_vs_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 20), rnd.randint(0, 5), rnd.randint(0, 10**6), f"v{i}") for i in range(2000)]
    # one hot key holding a third of the rows
    rows += [(999, 0, rnd.randint(0, 10**6), f"h{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, seq int, tie int, v string")
    got = {r["k"]: (r["seq"], r["tie"], r["v"]) for r in latest_per_key(df, ["k"], ["seq", "tie"]).collect()}
    want = {}
    for k, s, t, v in rows:
        if k not in want or (s, t) > want[k][:2]:
            want[k] = (s, t, v)
    assert got == want


def test_merge_latest_lower_sequence_never_wins(spark):
    tgt = spark.createDataFrame([(1, 5, "old"), (2, 1, "keep")], "k int, seq int, v string")
    chg = spark.createDataFrame([(1, 3, "late"), (3, 1, "new"), (2, 1, "same-seq")], "k int, seq int, v string")
    out = {r["k"]: r["v"] for r in merge_latest(tgt, chg, ["k"], ["seq"]).collect()}
    assert out == {1: "old", 2: "same-seq", 3: "new"}


def test_member_diff_case_insensitive(spark):
    cur = spark.createDataFrame([("Alice",), ("BOB",), ("bob",), ("carol",)], "k string")
    act = spark.createDataFrame([("alice",), ("DAVE",)], "k string")
    got = {(r["member_key"], r["change"]) for r in M.member_diff(cur, act, "k", "k").collect()}
    assert got == {("bob", "added"), ("carol", "added"), ("dave", "removed")}


def test_batch_groups_rounding_and_invalid(spark):
    rows = [("u1", "2024-01-01 10:01:00"), ("u2", "2024-01-01 10:04:59"), ("u3", "not a date"), ("u4", None),
            ("u5", "2024-01-01 10:01:00")]
    df = spark.createDataFrame(rows, "member_key string, t string")
    floored = df.withColumn("t", F.date_format(F.window(F.try_to_timestamp("t"), "5 minutes").start, "yyyy-MM-dd HH:mm:ss"))
    g = M.batch_groups(floored, "t").collect()
    assert len(g) == 1 and g[0]["n_rows"] == 3
    same = M.batch_groups(df, "t").collect()
    assert sorted(r["n_rows"] for r in same) == [1, 2]
    imm = M.batch_groups(df, None, as_of="2024-01-01 10:07:00").collect()
    assert len(imm) == 1 and str(imm[0]["batch_time"]) == "2024-01-01 10:05:00" and imm[0]["n_rows"] == 5


def test_phase_outcome_mixed_members_completes(spark):
    steps = spark.createDataFrame([
        ("p1", "m1", "succeeded"), ("p1", "m1", "succeeded"), ("p1", "m2", "failed"),
        ("p2", "m1", "failed"), ("p2", "m2", "cancelled"),
        ("p3", "m1", "succeeded"), ("p3", "m2", "polling"),
    ], "phase string, member string, status string")
    out = {r["phase"]: r["phase_status"] for r in PH.phase_outcome(steps, ["phase"], ["member"]).collect()}
    assert out == {"p1": "completed", "p2": "failed", "p3": "in_progress"}
    phases = spark.createDataFrame([("p1",), ("p4",)], "phase string")
    with_empty = {r["phase"]: r["phase_status"] for r in PH.with_empty_phases(phases, PH.phase_outcome(
        steps, ["phase"], ["member"]), ["phase"]).collect()}
    assert with_empty == {"p1": "completed", "p4": "completed"}


def test_batch_outcome_all_skipped_fails(spark):
    ph = spark.createDataFrame([("b1", "skipped"), ("b1", "superseded"), ("b2", "completed"), ("b2", "failed"),
                                ("b3", "pending"), ("b3", "completed")], "batch string, phase_status string")
    out = {r["batch"]: r["batch_status"] for r in PH.batch_outcome(ph, ["batch"]).collect()}
    assert out == {"b1": "failed", "b2": "completed", "b3": "in_progress"}


def test_next_dispatchable_step(spark):
    s = spark.createDataFrame([
        ("m1", 0, "succeeded"), ("m1", 1, "pending"), ("m1", 2, "pending"),
        ("m2", 0, "dispatched"), ("m2", 1, "pending"),
        ("m3", 0, "failed"), ("m3", 1, "pending"),
        ("m4", 0, "succeeded"),
    ], "m string, idx int, status string")
    out = {r["m"]: r["idx"] for r in PH.next_dispatchable_step(s, ["m"], ["idx"]).collect()}
    assert out == {"m1": 1}


def test_first_and_next_phase(spark):
    p = spark.createDataFrame([
        ("b", 0, 1, "completed"), ("b", 60, 2, "dispatched"), ("b", 1440, 3, "pending"), ("b", 7200, 4, "pending"),
    ], "batch string, offset_minutes int, id int, status string")
    r = PH.first_and_next_phase(p, ["batch"], ["offset_minutes", "id"]).first()
    assert (r["first_offset_minutes"], r["next_offset_minutes"], r["blocked"], r["in_progress"]) == (1440, 7200, True, True)
    p = spark.createDataFrame([
        ("b", 60, 1, "dispatched"), ("b", 60, 2, "pending"), ("b", 60, 3, "pending"), ("b", 90, 4, "completed"),
        ("c", 10, 5, "dispatched"), ("c", 5, 6, "completed"),
    ], "batch string, offset_minutes int, id int, status string")
    got = {r["batch"]: tuple(r)[1:] for r in PH.first_and_next_phase(p, ["batch"], ["offset_minutes", "id"]).collect()}
    assert got == {"b": (60, 2, None, None, False, True), "c": (None, None, None, None, False, True)}


def test_manual_advance_decision(spark):
    rows = spark.createDataFrame([
        (True, False, 1, False, False), (False, True, 1, False, False), (False, False, None, False, True),
        (False, False, None, False, False), (False, False, 1, True, True), (False, False, 1, False, True),
        (False, False, None, None, None)], "a boolean, b boolean, f int, bl boolean, p boolean")
    c = F.col
    got = [r["d"] for r in rows.select(PH.manual_advance_decision(c("a"), c("b"), c("f"), c("bl"), c("p")).alias("d")).collect()]
    assert got == ["dispatch_init", "wait_init", "wait", "completed", "wait", "dispatch_phase", "completed"]


def test_cancel_open_steps(spark):
    s = spark.createDataFrame([("m1", "pending"), ("m1", "succeeded"), ("m1", "polling"), ("m1", "poll_timeout"), ("m2", "pending")],
                              "m string, status string")
    failed = spark.createDataFrame([("m1",)], "m string")
    out = sorted((r["m"], r["status"]) for r in PH.cancel_open_steps(s, failed, ["m"]).collect())
    assert out == [("m1", "cancelled"), ("m1", "cancelled"), ("m1", "poll_timeout"), ("m1", "succeeded"), ("m2", "pending")]


def _fold(kinds, max_retries=2):
    status, fails, applied, ignored = "dispatched", 0, 0, 0
    for k in kinds:
        if status in ("succeeded", "failed"):
            ignored += 1
            continue
        if k == "success":
            status = "succeeded"
            applied += 1
        elif k == "failure":
            fails += 1
            status = "failed" if fails > max_retries else "retry_pending"
            applied += 1
        elif k == "polling":
            status = "polling"
            applied += 1
    return status, applied, ignored


def test_reduce_results_vs_sequential_fold(spark):
    rnd = random.Random(3)
    kinds = ["success", "failure", "polling", "heartbeat"]
    rows = []
    for key in range(60):
        n = rnd.randint(0, 12)
        for i in range(n):
            rows.append((key, rnd.randint(0, 50), i + key * 100, rnd.choices(kinds, [1, 3, 3, 2])[0]))
    df = spark.createDataFrame(rows, "k int, ts int, id int, kind string")
    got = {r["k"]: (r["final_status"], r["n_applied"], r["n_ignored"])
           for r in RS.reduce_results(df, ["k"], ["ts", "id"], "kind").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        seq = [r[3] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        want[key] = _fold(seq)
    assert got == want


def test_with_row_index_vs_python(spark):
    df = spark.range(0, 5000, 3).repartition(7).withColumnRenamed("id", "k")
    got = {r["k"]: r["row_index"] for r in L.with_row_index(df, ["k"]).collect()}
    want = {k: i for i, k in enumerate(range(0, 5000, 3))}
    assert got == want


def test_page_caps_limit(spark):
    df = spark.range(500)
    rows = L.page(df, [F.col("id").desc()], offset=10, limit=1000).collect()
    assert len(rows) == 100 and rows[0]["id"] == 489


def test_entity_selection_keeps_registry_order(spark):
    reg = spark.createDataFrame([
        ("users", 1, "graph", 0), ("groups", 1, "graph", 1), ("mailboxes", 2, "exo", 2), ("sites", 3, "spo", 3),
        ("devices", 2, "graph", 4), ("teams", 3, "graph", 5)], "name string, tier int, container string, ordinal int")
    sel = R.select_entities(reg, [1, 2], include=["teams"], exclude=["groups"])
    groups = {r[0]: r[1] for r in R.container_groups(sel).collect()}
    assert groups == {"graph": ["users", "devices", "teams"], "exo": ["mailboxes"]}


def test_tenant_modes(spark):
    t = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "tenant_key string, enabled boolean")
    keys = spark.createDataFrame([("a",), ("c",)], "tenant_key string")
    names = lambda df: sorted(r["tenant_key"] for r in df.collect())
    assert names(R.select_tenants(t, "all")) == ["a", "b"]
    assert names(R.select_tenants(t, "specific", keys)) == ["a"]
    assert names(R.select_tenants(t, "all_except", keys)) == ["b"]
    with pytest.raises(ValueError):
        R.select_tenants(t, "some")


def test_run_outcome(spark):
    t = spark.createDataFrame([("r1", "failed"), ("r1", "timeout"), ("r2", "failed"), ("r2", "succeeded"),
                               ("r3", "succeeded"), ("r4", "running")], "run string, status string")
    out = {r["run"]: r["run_status"] for r in R.run_outcome(t, ["run"]).collect()}
    assert out == {"r1": "failed", "r2": "completed_with_errors", "r3": "completed", "r4": "running"}
