"""F1 of round 4: the steps of ``silver_permissions_pipeline`` at size."""

from __future__ import annotations

import glob
import gzip
import io
import json
import os
from contextlib import redirect_stdout

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_large_later_change_set_is_reduced_with_the_stored_rows(spark, tmp_root, monkeypatch):
    """One shuffle, no join: a newer or equal change wins, an older one loses, keys
    may be NULL, columns may come later, untouched keys stay."""
    from inventa.sources import tables

    monkeypatch.setattr(tables, "BROADCAST_ROW_LIMIT", 3)
    t = tables.VersionedTable(spark, f"{tmp_root}/t", ["k"], ["s"], buckets=3)
    t.merge = None  # not used
    t.upsert(spark.createDataFrame([("a", 5, "old"), ("b", 5, "old"), ("c", 5, "old"), (None, 5, "old"), ("z", None, "old")], "k string, s int, v string"))
    late = [("a", 4, "new", 1), ("b", 5, "new", 2), ("c", 6, "new", 3), (None, 6, "new", 4), ("d", 1, "new", 5), ("d", 2, "newer", 6), ("z", None, "new", 7)]
    assert t.upsert(spark.createDataFrame(late, "k string, s int, v string, w int")) == 2
    assert {r["k"]: tuple(r[1:]) for r in t.read().select("k", "s", "v", "w").collect()} == {
        "a": (5, "old", None), "b": (5, "new", 2), "c": (6, "new", 3), None: (6, "new", 4), "d": (2, "newer", 6), "z": (None, "new", 7)}
    assert t.read().columns == ["k", "s", "v", "w"]
    assert {r["k"]: r["v"] for r in t.read(version=1).collect()} == {k: "old" for k in ("a", "b", "c", None, "z")}


def test_rows_are_dealt_once_by_bucket_unless_a_key_has_many(spark, tmp_root, monkeypatch):
    """A task has the rows of one bucket and sorts them by hash; a key with more
    rows than a task's is reduced where its rows lie."""
    from inventa.sources import tables

    seen = []
    latest = tables.latest_per_key

    def spy(df, keys, order_by):
        out = latest(df, keys, order_by)
        seen.append((keys, _plan(out), df))
        return out

    monkeypatch.setattr(tables, "latest_per_key", spy)
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 60)
    rows = spark.range(400).select(F.col("id").alias("k"), F.col("id").alias("s"))
    t = tables.VersionedTable(spark, f"{tmp_root}/t", ["k"], ["s"], buckets=4)
    t.upsert(rows)
    keys, plan, df = seen[-1]
    assert keys[0] == tables.HASH_COL and plan.count("Exchange") == 1
    per_task = df.groupBy(F.spark_partition_id()).agg(F.countDistinct(tables.BUCKET_COL).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert all(r["n"] == 1 and r["rows"] <= 120 for r in per_task) and len(per_task) == 8
    assert len(glob.glob(f"{tmp_root}/t/v000001/*/*.parquet")) == 8
    assert sorted((r["k"], r["s"]) for r in t.read().collect()) == [(i, i) for i in range(400)]

    hot = tables.VersionedTable(spark, f"{tmp_root}/hot", ["k"], ["s"], buckets=4)
    hot.upsert(rows.select(F.when(F.col("k") % 2 == 0, F.lit(-1)).otherwise(F.col("k")).alias("k"), "s"))
    keys, plan, _ = seen[-1]
    assert plan.index("partial_max_by") > plan.index("Exchange")  # below it: before the rows are dealt
    assert {r["k"]: r["s"] for r in hot.read().collect()} == {-1: 398, **{i: i for i in range(1, 400, 2)}}


def test_landing_leaves_rows_where_they_lie_well(spark, tmp_root, monkeypatch):
    """Few tenants over even tasks: no shuffle; many tenants, few rows or one large
    task: dealt as before."""
    from inventa import session
    from inventa.sources import landing

    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    deals = []
    write = landing.write_lines
    monkeypatch.setattr(landing, "write_lines", lambda df, *a, **k: (deals.append(_plan(df)), write(df, *a, **k)))
    cores = spark.sparkContext.defaultParallelism

    def land(run, tenants, parts, n=400 * cores):
        rows = spark.range(0, n, numPartitions=parts).select(
            F.col("id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("t"), F.col("id") % tenants)).alias("t"), F.lit("2024-01-01").alias("d"))
        landing.write_landing(rows, tmp_root, f"e{run}", "t", "d", run, compress=True)
        got = {}
        for f in glob.glob(f"{tmp_root}/e{run}/*/*/*.gz"):
            with gzip.open(f, "rt") as lines:
                for line in lines:
                    got[json.loads(line)["id"]] = f.split("/")[-3]
        assert got == {i: f"t{i % tenants}" if i % 9 > 0 else "__HIVE_DEFAULT_PARTITION__" for i in range(n)}
        return "Exchange" in deals[-1]

    assert not land("r1", 2, 2 * cores)
    assert len(glob.glob(f"{tmp_root}/er1/*/*/*.gz")) == 3 * 2 * cores
    assert land("r2", 150, 2 * cores)
    assert land("r3", 2, 1)
    assert land("r4", 2, 2 * cores, n=50)


def test_lines_are_dealt_to_folders_without_python_rows():
    import pyarrow as pa

    from inventa.sources.chunks import folder_lines

    rows = [("b", "d2", "1"), ("a", "d1", "2"), ("b", "d2", "é3"), ("b", "d1", ""), (None, "d1", "5"), ("a", "d1", "6")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in [("x", "x", "x"), *rows]]) for i in range(3)], names=["tenant", "day", "line"])
    got = [(t, d, bytes(b).decode()) for t, d, b in folder_lines(batch.slice(1))]
    assert got == [("b", "d2", "1\né3\n"), ("a", "d1", "2\n6\n"), ("b", "d1", "\n"), (None, "d1", "5\n")]
    assert [(t, d, bytes(b)) for t, d, b in folder_lines(batch.slice(0, 1))] == [("x", "x", b"x\n")]
    assert list(folder_lines(batch.slice(0, 0))) == []


SCHEMA = (T.StructType().add("id", "string").add("n", "long")
          .add("tags", T.ArrayType(T.StructType().add("a", "string").add("b", "double"))).add("on", "boolean"))
LINES = ['{"id":"1","n":2,"tags":[{"a":"x","b":1.5}],"on":true}', '{"n":2,"id":"1"}', '{"id":"1", "n":2}', '{"id":"1","n":null}', "{}", "null", "[]",
         '[{"id":"1"}]', '{"id":"1","id":"2"}', '{"id":"1","new":{"x":[1,2]},"z":null}', '{"id":"1"', '{"id":"1"} tail', "{'id':'1'}", '"text"', "no json",
         '{"id":"1","tags":[{"a":"x","c":3}]}', '{"id":"1","tags":[{"a":"x","a":"y"}]}', '{"id":7}', '{"n":"x"}', '{"n":1.0}', '{"tags":[null,{}]}',
         '{"ID":"1"}', '{"id":"\\u00e9"}', '{"id":"é"}', '{"tags":[{"b":NaN}]}', '{"id":"' + "x" * 1_100_000 + '"}']


def test_rescued_data_of_odd_lines(spark, tmp_root):
    """A line that is written as it was read is sound and is not read again; all
    others keep what they had."""
    from inventa.sources.landing import read_landing_rescued

    folder = f"{tmp_root}/e/t/2024-01-01"
    os.makedirs(folder)
    with open(f"{folder}/x.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n\n")
    got = read_landing_rescued(spark, tmp_root, "e", SCHEMA, streaming=False)
    known = F.array(*[F.lit(f.name) for f in SCHEMA.fields])
    extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~F.array_contains(known, k))
    want = spark.read.text(folder).where(F.trim("value") != "").select(
        F.from_json("value", SCHEMA).alias("r"),
        F.when(F.try_parse_json("value").isNull(), F.to_json(F.struct(F.col("value").alias("_corrupt_record"))))
         .when(F.size(extra) > 0, F.to_json(extra)).alias("_rescued_data")).select("r.*", "_rescued_data")
    rows = [tuple(r) for r in got.select("id", "n", "tags", "on", "_rescued_data", "_tenant_key").collect()]
    assert sorted(map(repr, rows)) == sorted(repr((*r, "t")) for r in want.collect())
    assert len(rows) == len(LINES) and sum(r[4] is not None for r in rows) > 5
    assert "json_object_keys" in _plan(got) or "jsonObjectKeys" in _plan(got)


def test_tenant_is_looked_for_in_the_end_of_the_path(spark, tmp_root):
    """Unless the landing folder itself lies below a date, which then comes first."""
    from inventa.sources import landing

    short = landing._varying(F.col("p"), landing.landing_glob(tmp_root, "e", "permissions"))
    assert "substring_index" in str(short)
    for root, tenant in ((f"{tmp_root}/a", "t"), (f"{tmp_root}/x/2024-02-02/y", "x")):
        for day, own in (("2024-01-01", tenant), ("latest", None if tenant == "t" else tenant)):
            for detail in (None, "permissions"):
                folder = f"{root}/{day}{detail}/e/t/{day}" + (f"/{detail}" if detail else "")
                os.makedirs(folder)
                with open(f"{folder}/x.jsonl", "w") as f:
                    f.write('{"id":"1"}\n')
                for read in (landing.read_landing, landing.read_landing_rescued):
                    got = read(spark, f"{root}/{day}{detail}", "e", SCHEMA, detail, streaming=False)
                    assert [r["_tenant_key"] for r in got.collect()] == [own]


def test_permission_entries_of_odd_arrays_in_generated_code(spark):
    from inventa.operators import arrays as A

    mb = "array<struct<trustee:string,accessRights:array<string>,isInherited:boolean,deny:boolean>>"
    sa = "array<struct<trustee:string,accessRights:array<string>,isInherited:boolean>>"
    rows = [(1, [("u1", ["FullAccess", "ReadPermission"], True, False), ("self", ["X"], False, False), None, (None, None, None, None)],
             [("u2", ["SendAs"], False), ("NT AUTHORITY\\SELF", [], None), (None, [None, "a"], True)], ["u3", None, "SELF", "u3"]),
            (2, None, None, None), (3, [], [], []), (4, None, [("u4", ["SendAs"], False)], None), (5, [], None, ["u5"])]
    df = spark.createDataFrame(rows, f"k int, mailboxPermissions {mb}, sendAsPermissions {sa}, sendOnBehalfTo array<string>")
    out = A.mailbox_permission_entries(df, ["k"])
    first = [(1, "MailboxPermission", "u1", "FullAccess,ReadPermission", True, False), (1, "MailboxPermission", None, "", None, None),
             (1, "MailboxPermission", None, "", None, None), (1, "SendAs", "u2", "SendAs", False, None), (1, "SendAs", None, "a", True, None)]
    behalf = [(1, "SendOnBehalf", t, "SendOnBehalf", False, None) for t in ("u3", None, "SELF", "u3")]
    rest = [(4, "SendAs", "u4", "SendAs", False, None), (5, "SendOnBehalf", "u5", "SendOnBehalf", False, None)]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, first + behalf + rest))
    kept = A.mailbox_permission_entries(df, ["k"], drop_self=False)
    assert kept.count() == len(first + behalf + rest) + 2
    assert "lambda" not in _plan(out)
