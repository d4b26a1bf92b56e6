"""Query sources, manifests, run history."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inventa.sources import manifests as MF
from inventa.sources import query_source as QS
from inventa.sources.landing import read_landing
from inventa.specs import BRONZE


def test_query_source_dispatch(spark):
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").createOrReplaceTempView("region_v")
    df = QS.run_query(spark, "Databricks", "SELECT r_regionkey, r_name FROM region_v")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string"]
    assert df.count() == 5
    for bad in ("", "  ", "oracle"):
        with pytest.raises(ValueError):
            QS.run_query(spark, bad, "SELECT 1")
    with pytest.raises(ValueError):
        QS.run_query(spark, "sql", " ")
    with pytest.raises(ValueError):
        QS.run_query(spark, "sql", "SELECT 1")  # no connection given


def test_all_string_keeps_null(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    assert QS.as_strings(df).first().asDict() == {"a": "1", "b": None}


def test_read_hidden_manifests(spark, tmp_root):
    for t, n in (("t1", 10), ("t2", 20)):
        d = f"{tmp_root}/users/{t}/2024-01-01"
        os.makedirs(d)
        with open(f"{d}/_manifest_r1.json", "w") as f:
            json.dump({"run_id": "r1", "tenant_key": t, "entity_type": "users", "phase1_record_count": n,
                       "status": "completed", "errors": ["e1"] if t == "t2" else []}, f, indent=2)
    m = MF.read_manifests(spark, tmp_root)
    got = sorted((r["tenant_key"], r["phase1_record_count"], r["errors"]) for r in m.collect())
    assert got == [("t1", 10, []), ("t2", 20, ["e1"])]


def test_run_history_roundtrip(spark, tmp_root):
    runs = spark.createDataFrame([("r1", "nightly", "completed", "2026-01-01"), ("r2", "nightly", "failed", "2026-01-02")],
                                 "run_id string, job_name string, status string, _day string")
    MF.write_history(runs, tmp_root, "runs", "_day", "h1")
    spec = BRONZE["orchestrator_runs"]
    back = read_landing(spark, tmp_root, spec.entity, spec.schema, streaming=False, tenant_from_dir=False,
                        levels=spec.levels)
    assert sorted((r["run_id"], r["status"]) for r in back.collect()) == [("r1", "completed"), ("r2", "failed")]


def test_manifest_records(spark):
    o = spark.createDataFrame([("t", "users", "processed", None), ("t", "users", "failed", "boom"),
                               ("t", "users", "skipped", None)],
                              "tenant_key string, entity_type string, status string, error string")
    r = MF.manifest_records(o, "r9").first()
    assert (r["phase2_record_count"], r["phase2_skipped_count"], r["failed_count"], r["errors"], r["status"]) == \
        (1, 1, 1, ["boom"], "completed_with_errors")


def test_query_columns_and_databases(spark):
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("nation_v")
    assert QS.query_columns(spark, "SELECT n_name AS name, n_regionkey + 1 AS r FROM nation_v") == ["name", "r"]
    QS.ensure_databases(spark)
    names = {r.namespace if hasattr(r, "namespace") else r[0] for r in spark.sql("SHOW DATABASES").collect()}
    assert {"bronze", "silver"} <= names
