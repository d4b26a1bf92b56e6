"""Dispatch lists in blocks; the chunk sink and the manifest reader."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inventa.operators import dispatch as DP
from inventa.sources import manifests as MF
from inventa.sources.chunks import ChunkWriter, TaskFiles, manifest_row
from inventa.sources.landing import read_landing, write_landing


def test_blocks_equal_a_plain_cut(spark, monkeypatch):
    monkeypatch.setattr(DP, "SLAB", 7)  # a group spans many slabs
    rows = [("hot", i) for i in range(100, 0, -1)] + [("cold", 5), (None, 3), (None, 3), ("nul", None), ("nul", 1)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r["g"], r["block_no"]): (r["n_blocks"], r["n_members"], r["members"])
           for r in DP.ordered_blocks(df, ["g"], "v", block=30).collect()}
    want = {("hot", i): (4, 100, list(range(30 * i + 1, min(30 * i + 30, 100) + 1))) for i in range(4)}
    assert got == {**want, ("cold", 0): (1, 1, [5]), (None, 0): (1, 2, [3, 3]), ("nul", 0): (1, 2, [1])}
    assert DP.ordered_blocks(df.limit(0), ["g"], "v").count() == 0


def test_due_phases_are_dispatched_once_and_only_with_members(spark):
    phases = spark.createDataFrame(
        [("b1", "p1", 1, "pending", "x"), ("b1", "p2", 9, "pending", "x"), ("b1", "p0", 1, "completed", "x"),
         ("b2", "p1", 1, "pending", "x"), ("b3", "p1", None, "pending", "x")],
        "batch_id string, phase_name string, due_at int, status string, members_note string")
    members = spark.createDataFrame([("b1", 2, "active"), ("b1", 1, "active"), ("b1", 3, "active"), ("b1", 4, "removed"),
                                     ("b2", 9, "failed"), ("b3", 8, "active"), (None, 7, "active")],
                                    "batch_id string, member_id long, status string")
    out = DP.due_phase_messages(phases, members, F.lit(5), block=2)
    got = sorted((r["batch_id"], r["phase_name"], r["block_no"], r["n_blocks"], r["n_members"], r["members"])
                 for r in out["messages"].collect())
    assert got == [("b1", "p1", 0, 2, 3, [1, 2]), ("b1", "p1", 1, 2, 3, [3])]
    state = {(r["batch_id"], r["phase_name"]): r["status"] for r in out["phases"].collect()}
    assert state == {("b1", "p1"): "dispatched", ("b1", "p2"): "pending", ("b1", "p0"): "completed",
                     ("b2", "p1"): "pending", ("b3", "p1"): "pending"}
    again = DP.due_phase_messages(out["phases"], members, F.lit(5), block=2)
    assert again["messages"].count() == 0


def test_member_messages_and_the_table_after(spark):
    stored = spark.createDataFrame(
        [("b", "Ann", "active", 1, None), ("b", "Bob", "active", None, None), ("b", "Cid", "active", 1, None),
         ("b", "Dan", "removed", 1, None), ("b", "Eva", "removed", 1, 1), ("b", "Fay", "failed", 1, None),
         ("b", "Gus", "active", None, None), ("idle", "Hal", "active", 1, None)],
        "batch_id string, member_key string, status string, add_dispatched_at int, remove_dispatched_at int")
    current = spark.createDataFrame([("b", "ANN"), ("b", "bob"), ("b", "EVA"), ("b", "New"), ("b", "new"), ("b", "fay")],
                                    "batch_id string, member_key string")
    out = DP.member_messages(stored, current, F.lit(2))
    got = {(r["step"], r["kind"]): r["members"] for r in out["messages"].collect()}
    assert got == {(0, "member-added"): ["Bob", "Gus"], (1, "member-removed"): ["Dan"],
                   (2, "member-added"): ["Eva", "Fay", "new"], (3, "member-removed"): ["Cid", "Gus"]}
    after = {r["member_key"]: tuple(r)[2:] for r in out["members"].collect()}
    assert after == {"Ann": ("active", 1, None), "Bob": ("active", 2, None), "Cid": ("removed", 1, 2),
                     "Dan": ("removed", 1, 2), "Eva": ("active", 2, None), "Fay": ("active", 2, None),
                     "new": ("active", 2, None), "Gus": ("removed", 2, 2), "Hal": ("active", 1, None)}
    settled = DP.member_messages(out["members"], current, F.lit(3))
    assert settled["messages"].count() == 0


def _files(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and ".landed" not in str(p))


def test_a_rerun_replaces_all_files_of_its_run(spark, tmp_root):
    df = spark.range(40).select("id", F.lit("t 1/x").alias("_t").substr(1, 3).alias("_t"), F.lit("2024-01-01").alias("_d"))
    write_landing(df, tmp_root, "e", "_t", "_d", "r0", chunk_prefix="chunk", num_files=2, detail_type="x")
    write_landing(df, tmp_root, "e", "_t", "_d", "r1", chunk_prefix="chunk", num_files=4, detail_type="x")
    assert len(_files(tmp_root)) == 6
    other = df.withColumn("_d", F.lit("2024-01-02"))
    write_landing(other, tmp_root, "e", "_t", "_d", "r1", chunk_prefix="chunk", num_files=3, detail_type="x")
    left = _files(tmp_root)
    assert [f for f in left if "_r0" in f] == [f"e/t 1/2024-01-01/x/chunk-00{i}_r0.jsonl" for i in range(2)]
    assert [f for f in left if "_r1" in f] == [f"e/t 1/2024-01-02/x/chunk-00{i}_r1.jsonl" for i in range(3)]
    back = read_landing(spark, tmp_root, "e", "id long", detail_type="x", streaming=False)
    assert back.count() == 80 and back.select("_tenant_key").distinct().collect() == [("t 1",)]


def test_missing_tenants_and_days_have_a_folder(spark, tmp_root):
    df = spark.createDataFrame([(1, None, "2024-01-01"), (2, "", "2024-01-01"), (3, "t", None)], "id long, _t string, _d string")
    write_landing(df, tmp_root, "e", "_t", "_d", "r")
    assert {f.rsplit("/", 1)[0] for f in _files(tmp_root)} == {
        "e/__HIVE_DEFAULT_PARTITION__/2024-01-01", "e/t/__HIVE_DEFAULT_PARTITION__"}
    write_landing(df.limit(0), tmp_root, "e", "_t", "_d", "r")
    assert _files(tmp_root) == []


def _writer(root, **more):
    return ChunkWriter({"root": f"{root}/e", "name": "chunk-*_r.jsonl", "record": f"{root}/.landed/e.json", **more})


def test_a_retried_task_replaces_its_file_and_leaves_no_attempt(tmp_root, monkeypatch):
    import pyarrow as pa
    from inventa.sources import chunks

    class Context:
        attempt = 7

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.attempt

    context = Context()
    monkeypatch.setattr(chunks, "TaskContext", type("T", (), {"get": staticmethod(lambda: context)}))
    batch = pa.RecordBatch.from_pydict({"tenant": ["a", "a", "b"], "day": ["d"] * 3, "line": ["1", "2", "3"]})

    def lost():
        yield batch
        raise RuntimeError("executor lost")

    w = _writer(tmp_root)
    with pytest.raises(RuntimeError):
        w.write(lost())
    # the file of tenant a was whole; that of b was not, so no reader sees it
    seen = [f for f in _files(tmp_root) if not os.path.basename(f).startswith(".")]
    assert seen == ["e/a/d/chunk-003_r.jsonl"]
    context.attempt = 8
    message = w.write(iter([batch, batch.slice(2)]))
    assert message == TaskFiles({"a/d": "chunk-003_r.jsonl", "b/d": "chunk-003_r.jsonl"}, 4)
    w.commit([message, None])
    assert _files(tmp_root) == ["e/a/d/chunk-003_r.jsonl", "e/b/d/chunk-003_r.jsonl"]
    assert Path(tmp_root, "e/b/d/chunk-003_r.jsonl").read_text() == "3\n3\n"
    w.abort([message, None])
    assert _files(tmp_root) == []


def test_manifests_of_many_folders(spark, tmp_root):
    for i in range(40):
        d = Path(tmp_root, f"users/t{i}/2024-01-01")
        d.mkdir(parents=True)
        (d / "_manifest_r1.json").write_text('{"tenant_key": "t%d", "phase1_record_count": %d}' % (i, i))
        (d / "users_r1.jsonl").write_text("{}\n")
    Path(tmp_root, "users/t0/2024-01-01/_manifest_r2.json").write_text("{broken")
    m = MF.read_manifests(spark, tmp_root, folders_per_task=4)
    assert m.rdd.getNumPartitions() == 10
    rows = m.collect()
    assert sorted(r["phase1_record_count"] for r in rows if r["status"] is None) == list(range(40))
    assert [r["manifest_path"].rsplit("/", 1)[1] for r in rows if r["status"] == "unreadable"] == ["_manifest_r2.json"]
    assert MF.read_manifests(spark, f"{tmp_root}/nothing").count() == 0


def test_manifest_fields_of_other_types_are_null():
    row = manifest_row(b'\xef\xbb\xbf{"run_id": 5, "phase1_record_count": "7", "phase2_record_count": true, "errors": "e"}', "p")
    assert row[0] is None and row[4] is None and row[5] is None and row[11] == ["e"] and row[12] == "p"
    assert manifest_row(b"[1]", "p")[10:12] == ("unreadable", ["no JSON object"])


def test_manifest_errors_beyond_the_first(spark):
    o = spark.createDataFrame([("t", "u", "failed", f"e{i}") for i in range(5)] + [("t", "u", "processed", None)],
                              "tenant_key string, entity_type string, status string, error string")
    assert MF.manifest_records(o, "r", max_errors=3).first()["errors"] == ["e0", "e1", "e2", "… 2 more"]


def test_chunk_writer_takes_rows_in_any_order(spark, tmp_root, monkeypatch):
    """More folders than open files, plain and compressed; the plan holds no
    rows back for a sort."""
    import io
    from contextlib import redirect_stdout

    from pyspark.sql import functions as F

    from inventa.sources import chunks
    from inventa.sources.landing import read_landing, write_landing

    rows = spark.range(0, 3000, 1, 3).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("_t"),
                                             F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("_d"))
    for entity, compress in (("plain", False), ("small", True)):
        write_landing(rows, tmp_root, entity, "_t", "_d", "r", detail_type="x", chunk_prefix="chunk", num_files=2, compress=compress)
        back = read_landing(spark, tmp_root, entity, "id long", detail_type="x", streaming=False)
        got = sorted((r["id"], r["_tenant_key"], r["_source_file"].split("/")[-3]) for r in back.collect())
        assert got == sorted((r["id"], r["_t"], r["_d"]) for r in rows.collect())
        names = {r[0].split("/")[-1] for r in back.select("_source_file").distinct().collect()}
        assert names == {f"chunk-00{i}_r.jsonl" + (".gz" if compress else "") for i in (0, 1)}
    seen = []
    monkeypatch.setattr(chunks.ChunkSink, "name", classmethod(lambda cls: "noop"))
    import inventa.sources.landing as landing
    monkeypatch.setattr(spark.dataSource.__class__, "register", lambda *a: None)
    old = type(rows).write.fget

    def write(df):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        seen.append(out.getvalue())
        return old(df)

    monkeypatch.setattr(type(rows), "write", property(write))
    landing.write_landing(rows, tmp_root, "noop", "_t", "_d", "r", chunk_prefix="chunk", num_files=2)
    assert seen and "Sort [" not in seen[0]
