"""Run planning and tracking on the provided tables.

Roles: customers are tenants (enabled = non-negative balance), nations are
the entity registry (tier = key mod 3 + 1, container = region), line items
are the tasks of a run (order); events are tasks of per-user daily runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.operators import runs as R
from inventa.operators.listing import with_row_index
from inventa.plans.registry import register
from inventa.session import table

TS_FMT = "yyyy-MM-dd HH:mm:ss"
TIERS = (1, 2)
INCLUDE = ("NATION_24",)
EXCLUDE = ("NATION_0",)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 + 1).alias("tier"),
                    F.concat(F.lit("container-"), F.col("n_regionkey").cast("string")).alias("container"),
                    F.col("n_nationkey").alias("ordinal"))


@register("run_plan", sql=f"""
WITH e AS (SELECT n_name, n_nationkey, 'container-' || CAST(n_regionkey AS VARCHAR) AS container FROM nation
           WHERE (n_nationkey % 3 + 1 IN {TIERS} OR n_name IN ('{INCLUDE[0]}')) AND n_name NOT IN ('{EXCLUDE[0]}')),
     g AS (SELECT container, string_agg(n_name, ',' ORDER BY n_nationkey) AS entities, COUNT(*) AS n_entities
           FROM e GROUP BY 1),
     t AS (SELECT c_name AS tenant_key FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD')
SELECT t.tenant_key, g.container, g.entities, CAST(g.n_entities AS INTEGER) AS n_entities FROM t, g
""")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants (all_except HOUSEHOLD, enabled only) × the
    selected entities grouped by container in registry order."""
    ents = R.select_entities(registry(spark, sf_dir), TIERS, INCLUDE, EXCLUDE)
    groups = R.container_groups(ents)
    c = table(spark, sf_dir, "customer")
    tenants = c.select(F.col("c_name").alias("tenant_key"), (F.col("c_acctbal") >= 0).alias("enabled"),
                       "c_mktsegment")
    chosen = R.select_tenants(tenants, "all_except",
                              tenants.filter(F.col("c_mktsegment") == "HOUSEHOLD").select("tenant_key"))
    plan = R.run_plan(chosen, groups)
    return plan.select("tenant_key", "container", F.array_join("entities", ",").alias("entities"),
                       F.size("entities").alias("n_entities"))


@register("tenant_override", sql="""
SELECT c_name AS tenant_key FROM customer
WHERE c_acctbal >= 0 AND c_name IN (SELECT c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                                    WHERE o.o_orderpriority = '1-URGENT')
""")
def tenant_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's tenant override — enabled tenants ∩ the override list
    (customers with an urgent order)."""
    c = table(spark, sf_dir, "customer")
    enabled = R.select_tenants(c.select(F.col("c_name").alias("tenant_key"),
                                        (F.col("c_acctbal") >= 0).alias("enabled")), "all")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    override = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_name").alias("tenant_key"))
    return R.override_tenants(enabled, override).select("tenant_key")


TASK_STATUS_SQL = """CASE WHEN l_returnflag = 'R' THEN 'failed'
     WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'timeout' ELSE 'succeeded' END"""


@register("run_status", sql=f"""
WITH t AS (SELECT l_orderkey, {TASK_STATUS_SQL} AS status FROM lineitem)
SELECT l_orderkey AS run_id,
       CASE WHEN bool_and(status IN ('failed', 'timeout', 'dispatch_failed')) THEN 'failed'
            WHEN bool_or(status IN ('failed', 'timeout', 'dispatch_failed')) THEN 'completed_with_errors'
            ELSE 'completed' END AS run_status
FROM t GROUP BY 1
""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run (order) outcome from its tasks (lines)."""
    li = table(spark, sf_dir, "lineitem")
    st = (F.when(F.col("l_returnflag") == "R", "failed")
           .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "timeout").otherwise("succeeded"))
    return R.run_outcome(li.select(F.col("l_orderkey").alias("run_id"), st.alias("status")), ["run_id"])


AS_OF_RUNS = "2024-01-20 06:00:00"


@register("run_timeout", sql=f"""
WITH t AS (SELECT user_id, CAST(ts AS DATE) AS run_day, ts,
                  CASE WHEN event_type IN ('view', 'click') THEN 'running'
                       WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status
           FROM events WHERE ts <= TIMESTAMP '{AS_OF_RUNS}'),
     r AS (SELECT user_id, run_day, min(ts) AS started FROM t GROUP BY 1, 2),
     u AS (SELECT t.user_id, t.run_day,
                  CASE WHEN t.status = 'running' AND r.started < TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 8 HOUR
                       THEN 'timeout' ELSE t.status END AS status
           FROM t JOIN r USING (user_id, run_day))
SELECT user_id, strftime(run_day, '%Y-%m-%d') AS run_day,
       COUNT(*) FILTER (WHERE status = 'timeout') AS n_timed_out,
       CASE WHEN bool_or(status = 'running') THEN 'running'
            WHEN bool_and(status IN ('failed', 'timeout', 'dispatch_failed')) THEN 'failed'
            WHEN bool_or(status IN ('failed', 'timeout', 'dispatch_failed')) THEN 'completed_with_errors'
            ELSE 'completed' END AS run_status
FROM u GROUP BY 1, 2
""")
def run_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks of runs (user, day) started more than 8 hours before
    ``as_of`` time out; then each run is rolled up."""
    as_of = F.lit(AS_OF_RUNS).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").filter(F.col("ts") <= as_of)
    t = e.select("user_id", F.to_date("ts").alias("run_day"), "ts",
                 F.when(F.col("event_type").isin("view", "click"), "running")
                 .when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    out = R.run_outcome_after_timeout(t, ["user_id", "run_day"], "ts", as_of)
    return out.select("user_id", F.date_format("run_day", "yyyy-MM-dd").alias("run_day"), "n_timed_out", "run_status")


@register("overlap", sql=f"""
WITH j AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS job_name FROM events),
     o AS (SELECT DISTINCT lower(event_type) AS j FROM events
           WHERE event_type IN ('view', 'click')
             AND ts > TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 8 HOUR AND ts <= TIMESTAMP '{AS_OF_RUNS}')
SELECT job_name, CASE WHEN lower(job_name) IN (SELECT j FROM o) THEN 'skipped_overlap' ELSE 'started' END AS decision
FROM j
""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job (event type, any case) with an open run in the last 8
    hours is skipped."""
    as_of = F.lit(AS_OF_RUNS).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
                    .alias("job_name")).distinct()
    open_runs = e.filter(F.col("event_type").isin("view", "click") & (F.col("ts") <= as_of)
                         & (F.col("ts") > F.timestamp_add("HOUR", F.lit(-8), as_of))).select(
        F.col("event_type").alias("job_name"))
    return R.overlap_decision(jobs, open_runs)


@register("config_checks", sql="""
SELECT 'unknown_tenant' AS rule, CAST(o_orderkey AS VARCHAR) AS item FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL
SELECT 'bad_status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL
SELECT 'duplicate_name', p_name FROM part GROUP BY p_name HAVING COUNT(*) > 1
UNION ALL
SELECT 'bad_tier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey % 7 NOT BETWEEN 1 AND 5
""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to missing tenants, values outside a CHECK
    domain, duplicate names, tiers outside 1-5 — one violations table."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    unknown = R.missing_references(o, c, "o_custkey", "c_custkey").select(
        F.lit("unknown_tenant").alias("rule"), F.col("o_orderkey").cast("string").alias("item"))
    bad = o.filter(~F.col("o_orderstatus").isin("O", "F")).select(
        F.lit("bad_status").alias("rule"), F.col("o_orderkey").cast("string").alias("item"))
    dup = R.duplicates(table(spark, sf_dir, "part"), ["p_name"]).select(
        F.lit("duplicate_name").alias("rule"), F.col("p_name").alias("item"))
    tier = F.col("s_nationkey") % 7
    lo, hi = R.TIER_RANGE
    bad_tier = table(spark, sf_dir, "supplier").filter(~tier.between(lo, hi)).select(
        F.lit("bad_tier").alias("rule"), F.col("s_suppkey").cast("string").alias("item"))
    return unknown.unionByName(bad).unionByName(dup).unionByName(bad_tier)


@register("version_next", sql="""
WITH n AS (SELECT o_orderpriority, max(o_custkey) + 1 AS next_version FROM orders GROUP BY 1)
SELECT n.o_orderpriority, n.next_version,
       (SELECT COUNT(*) FROM orders o WHERE o.o_orderpriority = n.o_orderpriority
          AND o.o_custkey < n.next_version) AS n_deactivated
FROM n
""")
def version_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing a runbook (priority) gets version max+1; all
    versions below it are deactivated."""
    return R.next_version(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


@register("latest_run", sql="""
SELECT o_custkey, max('run-' || strftime(o_orderdate, '%Y%m')) AS latest_run FROM orders GROUP BY 1
""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent run folder (run-YYYYMM) per customer."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.max(F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMM"))).alias("latest_run"))


@register("slices", sql="""
SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 5 AS BIGINT) AS slice FROM part
""")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin slice ``i % 5`` over the items in key order
    (global index without a single-partition window)."""
    idx = with_row_index(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    return idx.select("p_partkey", (F.col("row_index") % 5).alias("slice"))
