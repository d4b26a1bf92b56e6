"""Automaton folds, guarded transitions, retry limits, constraints, the upload
gate, expectation totals and run plans against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from inventa.operators import automaton, constraints, runs, transitions
from inventa.operators.result_fold import fold_results
from inventa.sources import csv_intake as CSV
from inventa.sources.tables import VersionedTable


def _requests(rng, n):
    current, requests = [], []
    for kind, names in transitions.TRANSITIONS.items():
        current += [(kind, f"e{i}", rng.choice(transitions.STATUSES[1:])) for i in range(20) if rng.random() < 0.8]
        for j in range(n):
            who = "e0" if rng.random() < 0.4 else f"e{rng.randrange(20)}" if rng.random() < 0.98 else None
            requests.append((kind, who, rng.randrange(1000), j, rng.choice([*names, "unknown", None])))
    return current, requests


def _walk(current, requests):
    status = {(k, i): s for k, i, s in current}
    out = []
    for k, i, t, j, r in sorted(requests, key=lambda x: x[2:4]):
        s = status.get((k, i), "absent")
        ok = r in transitions.TRANSITIONS[k] and s in transitions.expected(k, r)
        to = transitions.TRANSITIONS[k][r][1] if ok else s
        if ok:
            status[k, i] = to
        out.append((k, i, t, j, r, s, ok, to))
    return out


@pytest.mark.parametrize("block_rows", [1 << 16, 11])
def test_guarded_transitions_against_a_walk(spark, block_rows):
    current, requests = _requests(random.Random(block_rows), 300)
    c = spark.createDataFrame(current, "kind string, id string, status string")
    q = spark.createDataFrame(requests, "kind string, id string, t int, j int, request string").repartition(5)
    seen = transitions.outcomes(c, q, ["id"], ["t", "j"], block_rows=block_rows)
    want = _walk(current, requests)
    got = seen.collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    final = {(r["kind"], r["id"]): r for r in transitions.advance(seen, ["id"], ["t", "j"], "t").collect()}
    by = {}
    for r in want:
        by.setdefault(r[:2], []).append(r)
    for key, rs in by.items():
        done = [r for r in rs if r[6]]
        assert (final[key]["status"], final[key]["n_applied"], final[key]["n_refused"]) == (rs[-1][7], len(done), len(rs) - len(done))
        polls = [r[2] for r in done if r[4] == "set_polling"]
        assert (final[key]["poll_started_at"], final[key]["last_polled_at"]) == ((polls[0], polls[-1]) if polls else (None, None))
        ends = [r for r in done if r[4] in (*transitions.ENDS, "set_retry_pending")]
        assert final[key]["completed_at"] == (ends[-1][2] if ends and ends[-1][4] != "set_retry_pending" else None)


def test_pending_to_polling_in_one_batch_and_empty_tables(spark):
    c = spark.createDataFrame([("step", 1, "pending"), ("step", 2, "poll_timeout")], "kind string, id int, status string")
    q = spark.createDataFrame([("step", 1, 1, "set_dispatched"), ("step", 1, 2, "set_polling"), ("step", 1, 3, "set_succeeded"),
                               ("step", 1, 4, "set_failed"), ("step", 2, 1, "set_retry_pending"), ("step", 3, 1, "set_dispatched")],
                              "kind string, id int, t int, request string")
    got = {(r["id"], r["t"]): r["applied"] for r in transitions.outcomes(c, q, ["id"], ["t"]).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (1, 4): False, (2, 1): True, (3, 1): False}
    assert transitions.outcomes(c, q.limit(0), ["id"], ["t"]).count() == 0
    assert {r["applied"] for r in transitions.outcomes(c.limit(0), q, ["id"], ["t"]).collect()} == {False}


def test_automaton_limits(spark):
    with pytest.raises(ValueError):
        automaton.scan(spark.range(1), ["id"], ["id"], F.lit(b"x"), 257)


def _fold(rows, start=("dispatched", 0), most=2):
    status, failures, applied, ignored = *start, 0, 0
    for kind in rows:
        if status in ("succeeded", "failed", "poll_timeout", "cancelled"):
            ignored += 1
        elif kind == "success":
            status, applied = "succeeded", applied + 1
        elif kind == "polling":
            status, applied = "polling", applied + 1
        elif kind == "failure":
            failures, applied = failures + 1, applied + 1
            status = "failed" if failures > most else "retry_pending"
    return status, failures, applied, ignored


@pytest.mark.parametrize("block_rows", [1 << 16, 13])
def test_results_with_limits_of_their_own(spark, block_rows):
    rng = random.Random(4)
    limits = {f"s{i}": rng.choice([0, 1, 2, 5, 60, None]) for i in range(25)}
    rows = [(k, j, rng.choice(["failure", "failure", "polling", "heartbeat", "success" if rng.random() < 0.2 else "failure"]), limits[k])
            for j in range(1500) for k in [("s0" if rng.random() < 0.4 else f"s{rng.randrange(25)}")]]
    df = spark.createDataFrame(rows, "k string, t int, kind string, most int").repartition(6)
    start = {"s1": ("succeeded", 0), "s2": ("retry_pending", 1), "s3": ("polling", 0), "s4": ("poll_timeout", 2)}
    stored = spark.createDataFrame([(k, s, f, 7, 8) for k, (s, f) in start.items()] + [("none", "polling", 0, 0, 0)],
                                   "k string, status string, failures int, n_applied long, n_ignored long")
    for current in (None, stored):
        got = {r["k"]: tuple(r)[1:] for r in fold_results(df, ["k"], ["t"], "kind", F.col("most"), current, block_rows).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            own = [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == k]
            old = start.get(k) if current is not None else None
            s, f, a, i = _fold(own, old or ("dispatched", 0), 2 if limits[k] is None else limits[k])
            want[k] = (s, f, a + 7, i + 8) if old else (s, f, a, i)
        assert got == want


def test_batches_of_results_equal_one_fold(spark, tmp_root):
    """Results cut into micro-batches, with limits per step, give the states of
    one fold; a replayed batch changes nothing."""
    from inventa.streaming.reducers import apply_result_batch
    rng = random.Random(9)
    rows = [(f"s{rng.randrange(8)}", j, rng.choice(["failure", "polling", "heartbeat"] + ["success"] * (j % 5 == 0))) for j in range(240)]
    df = spark.createDataFrame([(*r, int(r[0][1:]) % 4) for r in rows], "k string, t int, kind string, most int")
    t = VersionedTable(spark, f"{tmp_root}/states", ["k"], [F.col("_batch")], buckets=3)
    for b in range(4):
        assert apply_result_batch(t, df.where(f"t >= {60 * b} AND t < {60 * b + 60}"), b, "k", ["t"], "kind", F.col("most"))
        assert not apply_result_batch(t, df, b, "k", ["t"], "kind", F.col("most"))
    got = {r["k"]: (r["status"], r["failures"], r["n_applied"], r["n_ignored"]) for r in t.read().collect()}
    assert got == {r["k"]: tuple(r)[1:] for r in fold_results(df, ["k"], ["t"], "kind", F.col("most")).collect()}


def _tables(spark):
    """The seven tables without a fault."""
    def empty(c):
        return spark.createDataFrame([c[0]], c[1])

    return {
        "runbooks": empty(((1, "a", 1, "y", "t", True, "rerun", False, False, "2024"), "id int, name string, version int, yaml_content string, "
                           "data_table_name string, is_active boolean, overdue_behavior string, ignore_overdue_applied boolean, "
                           "rerun_init boolean, created_at string")),
        "runbook_automation_settings": empty((("a", True), "runbook_name string, automation_enabled boolean")),
        "batches": empty(((1, 1, "2024", "active", "2024", False), "id int, runbook_id int, batch_start_time string, status string, "
                          "detected_at string, is_manual boolean")),
        "batch_members": empty(((1, 1, "u", "active", "2024"), "id int, batch_id int, member_key string, status string, added_at string")),
        "phase_executions": empty(((1, 1, "p", 0, 1, "skipped"), "id int, batch_id int, phase_name string, offset_minutes int, "
                                   "runbook_version int, status string")),
        "step_executions": empty(((1, 1, 1, "s", 0, "rolled_back", False, 0, 0), "id int, phase_execution_id int, batch_member_id int, "
                                  "step_name string, step_index int, status string, is_poll_step boolean, poll_count int, retry_count int")),
        "init_executions": empty(((1, 1, "s", 0, 1, "pending", False, 0, 0), "id int, batch_id int, step_name string, step_index int, "
                                  "runbook_version int, status string, is_poll_step boolean, poll_count int, retry_count int")),
    }


def test_constraints_of_the_seven_tables(spark):
    tables = _tables(spark)
    assert constraints.violations(tables).collect() == []
    more = {
        "batches": [(2, 9, None, "gone", "2024", False), (3, 1, "2024", None, "2024", False), (3, 1, None, "active", "2024", False),
                    (4, 1, None, "active", "2024", False)],
        "batch_members": [(2, 1, "u", "failed", "2024"), (3, 8, "w", "skipped", "2024")],
        "phase_executions": [(2, 1, "p", 0, 1, "cancelled"), (3, 1, "p", 0, 2, "pending")],
        "step_executions": [(2, 5, 1, "s", 0, "cancelled", False, 0, 0), (3, 1, 7, "s", 0, "pending", False, 0, None)],
        "init_executions": [(2, 1, "s", 0, 2, "rolled_back", False, 0, 0), (3, 1, "s", 0, 2, "pending", False, 0, 0)],
    }
    for name, rows in more.items():
        tables[name] = tables[name].unionByName(spark.createDataFrame(rows, tables[name].schema))
    found = {(r["table"], r["constraint"], tuple(json.loads(r["key"]).values()) if r["key"] else None, r["n"])
             for r in constraints.violations(tables).collect()}
    assert found == {
        ("batches", "FK_batch_runbook", (9,), 1), ("batches", "CK_batch_status", ("gone",), 1), ("batches", "NN_batches_status", None, 1),
        ("batches", "UQ_batch", (1, "2024"), 2), ("batches", "UQ_batch", (1, None), 2), ("batches", "PK_batches", (3,), 2),
        ("batch_members", "UQ_batch_member", (1, "u"), 2), ("batch_members", "FK_member_batch", (8,), 1),
        ("batch_members", "CK_member_status", ("skipped",), 1), ("phase_executions", "UQ_phase_exec", (1, "p", 1), 2),
        ("phase_executions", "CK_phase_status", ("cancelled",), 1), ("step_executions", "FK_step_phase", (5,), 1),
        ("step_executions", "FK_step_member", (7,), 1), ("step_executions", "NN_step_executions_retry_count", None, 1),
        ("init_executions", "CK_init_status", ("rolled_back",), 1), ("init_executions", "UQ_init_exec", (1, "s", 2), 2)}
    with pytest.raises(ValueError):
        constraints.violations({"batches": tables["batches"]})


def test_intake_rejects_whole_files(spark, tmp_root):
    def write(name, text):
        os.makedirs(f"{tmp_root}/up", exist_ok=True)
        with open(f"{tmp_root}/up/{name}.csv", "w", newline="") as f:
            f.write(text)

    write("good", "user_id,email\nA,1\nB,2\n")
    write("header_only", "user_id,email\n")
    write("many", "user_id,email\n" + "".join(f"k{i},x\n" for i in range(6)))
    write("wide", "user_id,email\n" + "z" * 400 + ",x\n")
    write("blank", "user_id,email\nA,1\n,2\n")
    write("twice", "user_id,email\nA,1\na,2\n")
    taken, found = CSV.intake(spark, f"{tmp_root}/up", "USER_ID", ["user_id", "email"], max_bytes=300, max_rows=5)
    assert sorted(r["user_id"] for r in taken.collect()) == ["A", "B"]
    codes = sorted((os.path.basename(r["_file"]), r["code"], r["_row"]) for r in found.collect())
    assert codes == [("blank.csv", "empty_key", 3), ("many.csv", "too_many_rows", None), ("twice.csv", "duplicate_key", 3),
                     ("wide.csv", "too_many_bytes", None)]
    none, missing = CSV.intake(spark, f"{tmp_root}/up", "user_id", ["user_id", "email", "dept"])
    assert none.count() == 0 and ("missing_column", "dept") in {(r["code"], r["key"]) for r in missing.collect()}


def test_expectation_totals_of_more_batches_than_spark_remembers(spark, tmp_root):
    from inventa.specs import BronzeSpec
    from inventa.streaming.bronze import run_bronze
    root = f"{tmp_root}/land/users/tenant-a/2024-01-01"
    os.makedirs(root)
    for i in range(115):
        with open(f"{root}/chunk-{i:03d}_run.jsonl", "w") as f:
            f.write("".join('{"id": %d}\n' % (10 * i + j) for j in range(3)))
    spec = BronzeSpec("bronze_users", "users", ddl="id long")
    totals = run_bronze(spark, f"{tmp_root}/land", f"{tmp_root}/bronze", spec, f"{tmp_root}/ck", f"{tmp_root}/metrics", max_files_per_trigger=1)
    rows = spark.read.parquet(f"{tmp_root}/bronze/bronze_users").count()
    assert rows == totals["rows"] == totals["passed"] + totals["failed"] == 345
    assert spark.read.parquet(f"{tmp_root}/metrics").agg(F.count("*"), F.sum("rows")).first()[:] == (115, 345)


def test_run_plan_without_a_limit(spark):
    entities = spark.range(12_000).selectExpr("concat('c', id % 40) AS container", "concat('e', id) AS name", "12000 - id AS ordinal")
    groups = runs.container_groups(entities)
    plan = runs.run_plan(spark.createDataFrame([("t1",), ("t2",)], "tenant_key string"), groups).collect()
    assert len(plan) == 80 and all(len(r["entities"]) == 300 for r in plan)
    assert plan[0]["entities"][0] == f"e{11960 + int(plan[0]['container'][1:])}"
