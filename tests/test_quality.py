"""Validation rules, retention by age, expectation metrics table."""

import json
import os

from pyspark.sql import functions as F

from inventa.operators import quality as Q
from inventa.sources.tables import VersionedTable
from inventa.specs import BronzeSpec
from inventa.streaming.bronze import run_bronze


def test_tenant_rules(spark):
    t = spark.createDataFrame([("contoso",), ("CONTOSO",), ("fabrikam",), ("fabrikam",)], "tenant_key string")
    assert [tuple(r) for r in Q.tenant_rules(t).collect()] == [("duplicate_tenant", "fabrikam", "2")]


def test_storage_auth_rules(spark):
    s = spark.createDataFrame([
        ("a", "managed_identity", None, None, None), ("b", "service_principal", "t", " ", None), ("c", "key", None, None, None),
        ("d", None, None, None, None)], "name string, method string, tenant_id string, client_id string, cert_name string")
    got = sorted((r["rule"], r["item"], r["detail"] or "") for r in Q.storage_auth_rules(s).collect())
    assert got == [("bad_auth_method", "c", "key"), ("bad_auth_method", "d", ""),
                   ("missing_auth_field", "b", "cert_name"), ("missing_auth_field", "b", "client_id")]


def test_job_rules(spark):
    jobs = spark.createDataFrame([
        ("nightly", [1, 5], "all", [], [], ["users"], None), ("weekly", [7, 0], "specific", None, ["x"], ["users", "ghosts"], ["phantom"]),
        ("adhoc", None, "some", ["zz"], [], [], []), (" ", [2], "all_except", ["contoso"], [], [], []),
        ("fine", [3], "all_except", [], ["contoso"], [], ["users"])],
        "name string, include_tiers array<int>, tenant_mode string, tenant_keys array<string>, exclude_keys array<string>, "
        "include_entities array<string>, exclude_entities array<string>")
    ents = spark.createDataFrame([("users",)], "name string")
    tens = spark.createDataFrame([("contoso",)], "tenant_key string")
    got = sorted((r["rule"], r["item"], r["detail"]) for r in Q.job_rules(jobs, ents, tens).fillna("").collect())
    assert got == sorted([
        ("bad_tier", "weekly", "7,0"), ("tenant_list_required", "weekly", "tenant_keys"), ("unknown_entity", "weekly", "include_entities:ghosts"),
        ("unknown_entity", "weekly", "exclude_entities:phantom"), ("unknown_tenant", "weekly", "exclude_keys:x"),
        ("unknown_tenant", "adhoc", "tenant_keys:zz"), ("unknown_tenant_mode", "adhoc", "some"),
        ("missing_job_name", " ", ""), ("tenant_list_required", " ", "exclude_keys")])


def test_step_rules_and_expected_columns(spark):
    steps = spark.createDataFrame([
        ("rb", "a", "Fn", "T-1d", None, None, "{{User}} {{_batch_id}}", None),
        ("rb", "A", "Fn", "T--5d", "5m", "1m", "{{x}", "undo"),
        ("rb", "", None, "T-0", None, None, "ok", None),
    ], "runbook string, step string, fn string, offset string, pi string, pt string, tmpl string, rollback string")
    known = spark.createDataFrame([("revert",)], "rollback string")
    rules = sorted(r["rule"] for r in Q.step_rules(steps, "runbook", "step", "fn", offset="offset", poll_interval="pi",
                                                   poll_timeout="pt", params_template="tmpl", rollback="rollback",
                                                   known_rollbacks=known).collect())
    assert rules == ["bad_offset", "duplicate_step", "missing_function", "missing_name", "template_braces", "unknown_rollback"]
    cols = sorted(r["column_name"] for r in Q.expected_columns(steps, "runbook", "tmpl", F.lit("UserId"),
                                                               output_params=["x"]).collect())
    assert cols == ["User", "UserId"]


def test_vacuum_older_than(spark, tmp_root):
    t = VersionedTable(spark, f"{tmp_root}/vt", ["k"], [F.col("s")], buckets=2)
    for s in range(3):
        t.upsert(spark.createDataFrame([(s, s)], "k int, s int"))
    t.vacuum_older_than(7, now=t.history()[-1]["committed_at"] + 7 * 86400 + 1)
    assert t.versions() == [3]
    assert sorted(tuple(r) for r in t.read().collect()) == [(0, 0), (1, 1), (2, 2)]


def test_expectation_metrics_table(spark, tmp_root):
    for tenant, day in (("t1", "2024-01-01"), ("misc", "latest")):
        d = f"{tmp_root}/landing/pages/{tenant}/{day}"
        os.makedirs(d)
        with open(f"{d}/pages_r1.jsonl", "w") as f:
            f.write(json.dumps({"page_id": 1}) + "\n" + json.dumps({"page_id": 2}) + "\n")
    spec = BronzeSpec("pages", "pages", ddl="page_id long")
    totals = run_bronze(spark, f"{tmp_root}/landing", f"{tmp_root}/bronze", spec, f"{tmp_root}/ck",
                        metrics_path=f"{tmp_root}/metrics")
    assert totals == {"rows": 4, "passed": 2, "failed": 2}
    m = spark.read.parquet(f"{tmp_root}/metrics").agg(F.sum("passed"), F.sum("failed")).first()
    assert tuple(m) == (2, 2)
