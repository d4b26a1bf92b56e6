"""Dispatch lists and manifests read back, on the provided tables.

Roles: orders of a month are the members of a batch, customers of a nation are
the members of a batch, line items of a ship month are a run's items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.functions import durations as D
from inventa.operators import dispatch as DP
from inventa.plans.columns import OFFSET_SQL, PHASES_VALUES, runbook_phases_col
from inventa.plans.phases import AS_OF_DUE, TS_FMT
from inventa.plans.registry import register
from inventa.session import scratch_path, table
from inventa.sources.landing import read_landing, write_landing
from inventa.sources.manifests import manifest_records, read_manifests, write_manifests

_OFF = OFFSET_SQL.format(o="p.off")


@register("phase_dispatch_lists", sql=f"""
WITH b AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS batch_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t
           FROM orders),
     p AS (SELECT b.batch_id, p.phase_name, b.t - to_minutes(CAST({_OFF} AS BIGINT)) AS due_at
           FROM b, (VALUES {PHASES_VALUES}) p(phase_name, off, phase_index) WHERE ({_OFF}) IS NOT NULL),
     m AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch_id, o_orderkey AS k,
                  row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS rn,
                  COUNT(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n
           FROM orders WHERE o_orderstatus <> 'F'),
     l AS (SELECT batch_id, rn // 100 AS block_no, max(n) AS n_members,
                  string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS member_ids FROM m GROUP BY 1, 2)
SELECT p.batch_id, p.phase_name, strftime(p.due_at, '%Y-%m-%d %H:%M:%S') AS due_at, l.block_no,
       CAST(ceil(l.n_members / 100.0) AS BIGINT) AS n_blocks, l.n_members, l.member_ids
FROM p JOIN l USING (batch_id) WHERE p.due_at <= TIMESTAMP '{AS_OF_DUE}'
""")
def phase_dispatch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The due phases of every monthly batch with its active members, in
    ordered blocks of 100."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    month = F.date_format("o_orderdate", "yyyy-MM")
    batches = o.select(month.alias("batch_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("_t")).distinct()
    phases = (batches.select("batch_id", "_t", F.explode(runbook_phases_col()).alias("p"))
              .filter(F.col("p.offset_minutes").isNotNull())
              .select("batch_id", F.col("p.phase_name").alias("phase_name"),
                      D.due_at("_t", F.col("p.offset_minutes")).alias("due_at"), F.lit("pending").alias("status")))
    members = o.select(month.alias("batch_id"), F.col("o_orderkey").alias("member_id"),
                       F.when(F.col("o_orderstatus") == "F", "removed").otherwise("active").alias("status"))
    out = DP.due_phase_messages(phases, members, F.lit(AS_OF_DUE).cast("timestamp_ntz"), block=100)["messages"]
    return out.select("batch_id", "phase_name", F.date_format("due_at", TS_FMT).alias("due_at"), "block_no", "n_blocks",
                      "n_members", F.array_join("members", ",").alias("member_ids"))


@register("member_dispatch_lists", sql="""
WITH c AS (SELECT c_nationkey AS batch_id, c_name AS name, c_mktsegment <> 'AUTOMOBILE' AS stored,
                  c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AS active,
                  c_mktsegment = 'BUILDING' AS removed, c_acctbal > 0 AS present,
                  c_acctbal < 3000 AS add_open, c_acctbal > 6000 AS remove_open FROM customer),
     x AS (SELECT batch_id, 0 AS step, 'member-added' AS kind, name FROM c WHERE active AND add_open
           UNION ALL SELECT batch_id, 1, 'member-removed', name FROM c WHERE removed AND remove_open
           UNION ALL SELECT batch_id, 2, 'member-added', CASE WHEN stored THEN name ELSE lower(name) END FROM c
             WHERE present AND NOT active
           UNION ALL SELECT batch_id, 3, 'member-removed', name FROM c WHERE active AND NOT present
             AND batch_id IN (SELECT batch_id FROM c WHERE present)),
     r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, step ORDER BY name) - 1 AS rn,
                  COUNT(*) OVER (PARTITION BY batch_id, step) AS n FROM x)
SELECT batch_id, step, kind, rn // 10 AS block_no, CAST(ceil(max(n) / 10.0) AS BIGINT) AS n_blocks,
       max(n) AS n_members, string_agg(name, ',' ORDER BY name) AS member_keys
FROM r GROUP BY batch_id, step, kind, rn // 10
""")
def member_dispatch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sync of the batches (nations) with their query result (customers
    of positive balance, keys in another case): additions and removals stored but
    never dispatched, then the new ones, in ordered blocks of 10."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_mktsegment", "c_acctbal")
    seg, then = F.col("c_mktsegment"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stored = c.filter(seg != "AUTOMOBILE").select(
        F.col("c_nationkey").alias("batch_id"), F.col("c_name").alias("member_key"),
        F.when(seg == "BUILDING", "removed").when(seg == "MACHINERY", "failed").otherwise("active").alias("status"),
        F.when(F.col("c_acctbal") >= 3000, then).alias("add_dispatched_at"),
        F.when(F.col("c_acctbal") <= 6000, then).alias("remove_dispatched_at"))
    current = c.filter(F.col("c_acctbal") > 0).select(F.col("c_nationkey").alias("batch_id"),
                                                      F.upper("c_name").alias("member_key"))
    out = DP.member_messages(stored, current, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), block=10)["messages"]
    return out.select("batch_id", "step", "kind", "block_no", "n_blocks", "n_members",
                      F.array_join("members", ",").alias("member_keys"))


@register("manifest_audit", sql="""
WITH x AS (SELECT 'tenant-' || l_returnflag AS tenant_key, strftime(l_shipdate, '%Y-%m-01') AS day,
                  'item ' || (l_orderkey * 10 + l_linenumber) || ' failed' AS err,
                  CASE WHEN l_linestatus = 'F' THEN 'processed' WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'failed' END AS st
           FROM lineitem),
     e AS (SELECT tenant_key, day, string_agg(err, '; ' ORDER BY err) AS errs
           FROM (SELECT *, row_number() OVER (PARTITION BY tenant_key, day ORDER BY err) AS rn FROM x WHERE st = 'failed')
           WHERE rn <= 50 GROUP BY 1, 2),
     n AS (SELECT tenant_key, day, COUNT(*) FILTER (WHERE st = 'processed') AS done,
                  COUNT(*) FILTER (WHERE st = 'skipped') AS skipped, COUNT(*) FILTER (WHERE st = 'failed') AS failed
           FROM x GROUP BY 1, 2)
SELECT n.tenant_key, n.day, n.done AS phase2_record_count, n.skipped AS phase2_skipped_count,
       CASE WHEN n.failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status,
       coalesce(e.errs, '') || CASE WHEN n.failed > 50 THEN '; … ' || (n.failed - 50) || ' more' ELSE '' END AS errors_text,
       n.done AS n_landed
FROM n LEFT JOIN e USING (tenant_key, day)
""")
def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run lands its processed items as chunk files and a
    manifest per tenant and day (ship month); the manifests are read back and
    each is compared with the rows that landed beside it."""
    root = scratch_path(spark, "manifest_audit")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    st = (F.when(F.col("l_linestatus") == "F", "processed").when(F.col("l_returnflag") == "A", "skipped").otherwise("failed"))
    items = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), st.alias("status"),
                      F.concat(F.lit("tenant-"), "l_returnflag").alias("tenant_key"), F.lit("items").alias("entity_type"),
                      F.date_format("l_shipdate", "yyyy-MM-01").alias("_day"))
    items = items.withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("item "), F.col("item"), F.lit(" failed"))))
    write_landing(items.filter("status = 'processed'").select("item", "tenant_key", "_day"), root, "items", "tenant_key", "_day",
                  "r1", detail_type="lines", chunk_prefix="chunk", num_files=4)
    records = manifest_records(items, "r1", ("tenant_key", "entity_type", "_day"))
    write_manifests(records.withColumn("_t", F.col("tenant_key")), root, "items", "_t", "_day", "r1")

    def day(path: str):
        return F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})/", 1).alias("day")

    landed = (read_landing(spark, root, "items", "item long", detail_type="lines", streaming=False)
              .groupBy(F.col("_tenant_key").alias("tenant_key"), day("_source_file")).agg(F.count("item").alias("n_landed")))
    m = read_manifests(spark, root).select("tenant_key", day("manifest_path"), "phase2_record_count", "phase2_skipped_count",
                                           "status", F.array_join("errors", "; ").alias("errors_text"))
    return (m.join(landed, ["tenant_key", "day"], "left")
            .withColumn("n_landed", F.coalesce("n_landed", F.lit(0).cast("long"))))
