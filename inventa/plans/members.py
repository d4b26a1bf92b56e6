"""Batch grouping, preview and member set operations on the provided tables.

Roles: ``events`` rows are query-result rows (member = user), ``customer``
rows are the members a runbook query returns, ``orders`` are batches (open
orders = active batches), ``lineitem`` rows are batch members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inventa.functions.durations import batch_time_floor
from inventa.operators import members as M
from inventa.plans.registry import register
from inventa.session import table

TS_FMT = "yyyy-MM-dd HH:mm:ss"


@register("batch_groups", sql="""
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS batch_time,
       COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS n_members
FROM events WHERE event_type <> 'error'
GROUP BY 1
""")
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows grouped by batch time text (the 5-minute tick of
    their timestamp); 'error' rows carry an unparsable time and are skipped."""
    e = table(spark, sf_dir, "events")
    text = (F.when(F.col("event_type") == "error", F.lit("not a time"))
             .otherwise(F.date_format(batch_time_floor("ts"), TS_FMT)))
    g = M.batch_groups(e.withColumn("member_key", F.col("user_id").cast("string")), text)
    return g.select(F.date_format("batch_time", TS_FMT).alias("batch_time"), "n_rows", "n_members")


@register("preview", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS batch_date, COUNT(*) AS n_rows,
       (SELECT COUNT(*) FROM events) AS total_rows, 6 AS n_columns
FROM events GROUP BY 1
""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview of a query result: total rows, column count and row
    counts per batch date."""
    e = table(spark, sf_dir, "events")
    groups = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("batch_date")).agg(F.count(F.lit(1)).alias("n_rows"))
    # the total is summed over the (few) group rows, not over the data again
    return (groups.withColumn("total_rows", F.sum("n_rows").over(Window.partitionBy()))
            .withColumn("n_columns", F.lit(len(e.columns))))


@register("preview_sample", sql="""
SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 100
""")
def preview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview's first 100 rows (a top-k: the limit is the feature)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(100)


ACTIVE_CUSTOMERS_SQL = """SELECT DISTINCT upper(c.c_name) AS member_key FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'O'"""


def _active_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O").select("o_custkey").distinct()
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.upper("c_name").alias("member_key"))


@register("member_diff", sql=f"""
WITH cur AS (SELECT DISTINCT lower(c_name) AS k FROM customer WHERE c_acctbal > 0),
     act AS (SELECT DISTINCT lower(member_key) AS k FROM ({ACTIVE_CUSTOMERS_SQL}))
SELECT k AS member_key, 'added' AS change FROM cur WHERE k NOT IN (SELECT k FROM act)
UNION ALL
SELECT k AS member_key, 'removed' AS change FROM act WHERE k NOT IN (SELECT k FROM cur)
""")
def member_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runbook query result (customers with a positive balance) vs
    the active members (customers with an open order, stored upper-case)."""
    cur = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return M.member_diff(cur, _active_members(spark, sf_dir), "c_name", "member_key")


@register("active_elsewhere", sql="""
WITH c AS (SELECT DISTINCT o_orderpriority AS runbook, o_custkey AS member FROM orders WHERE o_orderstatus = 'F'),
     a AS (SELECT DISTINCT o_orderpriority AS runbook, o_custkey AS member FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT runbook, member,
       CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.runbook = c.runbook AND a.member = c.member)
            THEN 'skip' ELSE 'new' END AS decision
FROM c
""")
def active_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate members (customers of finished orders, per runbook =
    priority) already in an active batch of the same runbook are skipped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("runbook"),
                                             F.col("o_custkey").alias("member"), "o_orderstatus")
    cand = o.filter(F.col("o_orderstatus") == "F").select("runbook", "member").distinct()
    act = o.filter(F.col("o_orderstatus").isin("O", "P"))
    keys = ["runbook", "member"]
    return (M.in_active_batch(cand, act, keys).withColumn("decision", F.lit("skip"))
            .unionByName(M.drop_active_elsewhere(cand, act, keys).withColumn("decision", F.lit("new"))))


@register("resume_filter", sql="""
SELECT p_partkey FROM part
WHERE lower('Part-' || CAST(p_partkey AS VARCHAR)) NOT IN
      (SELECT lower('PART-' || CAST(l_partkey AS VARCHAR)) FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01 00:00:00')
""")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume an export — drop item ids already in the progress set
    (case-insensitive)."""
    items = table(spark, sf_dir, "part").select(
        "p_partkey", M.key_norm(F.concat(F.lit("Part-"), F.col("p_partkey").cast("string"))).alias("_k"))
    done = (table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1995-03-01 00:00:00").cast("timestamp_ntz"))
            .select(M.key_norm(F.concat(F.lit("PART-"), F.col("l_partkey").cast("string"))).alias("_k")))
    return M.drop_active_elsewhere(items, done, ["_k"]).select("p_partkey")


@register("member_refresh", sql=f"""
SELECT a.member_key, c.c_acctbal AS fresh_balance, c.c_mktsegment AS fresh_segment
FROM ({ACTIVE_CUSTOMERS_SQL}) a JOIN customer c ON lower(a.member_key) = lower(c.c_name)
""")
def member_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active members still returned by the query get the fresh row."""
    cur = table(spark, sf_dir, "customer")
    r = M.refresh_members(_active_members(spark, sf_dir), cur, "member_key", "c_name")
    return r.select("member_key", F.col("_fresh.c_acctbal").alias("fresh_balance"),
                    F.col("_fresh.c_mktsegment").alias("fresh_segment"))


@register("member_add", sql=f"""
WITH r AS (SELECT DISTINCT c_mktsegment, lower(c_name) AS k FROM customer),
     a AS (SELECT DISTINCT lower(member_key) AS k FROM ({ACTIVE_CUSTOMERS_SQL}))
SELECT c_mktsegment,
       COUNT(*) FILTER (WHERE k NOT IN (SELECT k FROM a)) AS n_added,
       COUNT(*) FILTER (WHERE k IN (SELECT k FROM a)) AS n_skipped
FROM r GROUP BY 1
""")
def member_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual member add per segment: added vs already-active counts."""
    req = table(spark, sf_dir, "customer")
    return M.add_members(req, _active_members(spark, sf_dir), "c_name", "member_key", ["c_mktsegment"])


DETECT_CUTOFF = "2024-01-10"


@register("batch_detection", sql=f"""
WITH r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS m, CAST(ts AS DATE) AS d FROM events),
     nb AS (SELECT d, COUNT(*) AS n FROM r WHERE d >= DATE '{DETECT_CUTOFF}' GROUP BY d),
     cur AS (SELECT d, m FROM r WHERE d < DATE '{DETECT_CUTOFF}' AND day(d) % 4 <> 0),
     sto AS (SELECT CAST(d + INTERVAL 1 DAY AS DATE) AS d, m FROM r
             WHERE d + INTERVAL 1 DAY < DATE '{DETECT_CUTOFF}'
               AND CAST(d + INTERVAL 1 DAY AS DATE) IN (SELECT d FROM cur)),
     ch AS (SELECT d, 'added' AS kind FROM (SELECT d, m FROM cur EXCEPT SELECT d, m FROM sto)
            UNION ALL SELECT d, 'removed' FROM (SELECT d, m FROM sto EXCEPT SELECT d, m FROM cur))
SELECT 'new_batch' AS kind, strftime(d, '%Y-%m-%d') AS batch_date, n FROM nb
UNION ALL SELECT 'phases', strftime(d, '%Y-%m-%d'), CAST(3 AS BIGINT) FROM nb
UNION ALL SELECT kind, strftime(d, '%Y-%m-%d'), COUNT(*) FROM ch GROUP BY kind, d
UNION ALL SELECT 'refreshed', strftime(d, '%Y-%m-%d'), COUNT(*) FROM (SELECT d, m FROM cur INTERSECT SELECT d, m FROM sto) GROUP BY d
""")
def batch_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection pass — event rows grouped into daily
    batches; days before the cut-off are stored batches (their stored
    members are the previous day's users; every fourth day's batch is
    completed and left alone), later days become new batches with a member
    snapshot and the runbook's three valid phases."""
    from inventa.plans.columns import RUNBOOK_PHASES
    from inventa.functions.durations import lenient_timestamp, offset_minutes
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    rows = e.select(F.col("user_id").cast("string").alias("member"),
                    F.date_format(day, "yyyy-MM-dd 00:00:00").alias("bt"), day.alias("d"))
    bid = M.batch_id_for(F.lit("rb"), lenient_timestamp(F.col("bt")))
    old = rows.filter(F.col("d") < F.lit(DETECT_CUTOFF).cast("date"))
    existing = old.select(bid.alias("batch_id"), "d").distinct().withColumn(
        "status", F.when(F.dayofmonth("d") % 4 == 0, "completed").otherwise("active"))
    prev = old.select("member", F.date_add("d", 1).alias("d")).filter(F.col("d") < F.lit(DETECT_CUTOFF).cast("date"))
    stored = prev.join(existing, "d").select("batch_id", F.col("member").alias("member_key"))
    phases = F.array(*[F.struct(F.lit(n).alias("phase_name"), offset_minutes(F.lit(o)).alias("offset_minutes"))
                       for n, o in RUNBOOK_PHASES if o != "T-1.5d"])
    out = M.detect_batches(rows, "rb", "member", "bt", existing, stored, phases)
    nb = out["new_batches"].select(F.lit("new_batch").alias("kind"),
                                   F.date_format("batch_start_time", "yyyy-MM-dd").alias("batch_date"),
                                   F.col("n_members").alias("n"))
    ph = (out["new_phases"].join(out["new_batches"].select("batch_id", "batch_start_time"), "batch_id")
          .groupBy(F.date_format("batch_start_time", "yyyy-MM-dd").alias("batch_date"))
          .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("phases")))
    ch = (out["member_changes"].unionByName(out["refreshed"].withColumn("change", F.lit("refreshed")))
          .join(existing, "batch_id")
          .groupBy(F.col("change").alias("kind"), F.date_format("d", "yyyy-MM-dd").alias("batch_date"))
          .agg(F.count(F.lit(1)).alias("n")))
    return nb.unionByName(ph).unionByName(ch)


IMMEDIATE_AS_OF = "2024-01-01 10:07:31"


@register("batch_detection_immediate", sql="""
SELECT 'member' AS kind, CAST(c_custkey AS VARCHAR) AS member_key, '2024-01-01 10:05:00' AS batch_time,
  '{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '"}' AS data_json
FROM customer WHERE c_nationkey % 4 <> 0
UNION ALL
SELECT 'batch', CAST((SELECT count(*) FROM customer WHERE c_nationkey % 4 <> 0) AS VARCHAR), '2024-01-01 10:05:00', NULL
""")
def batch_detection_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13, immediate mode: customers of one tick make a batch, without those
    active in an unfinished batch (members of finished batches, and members
    removed from running ones, are taken); each with its row as JSON."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    kind = F.col("c_nationkey") % 4
    stored = rows.select(F.when(kind == 0, 1).when(kind == 1, 2).otherwise(1).cast("long").alias("batch_id"),
                         F.col("c_custkey").cast("string").alias("member_key"),
                         F.when(kind == 2, "removed").otherwise("active").alias("status")).where(kind < 3)
    existing = spark.range(1, 3).select(F.col("id").alias("batch_id"),
                                        F.when(F.col("id") == 1, "active").otherwise("completed").alias("status"))
    phases = F.array(F.struct(F.lit("now").alias("phase_name"), F.lit(0).cast("long").alias("offset_minutes")))
    out = M.detect_batches(rows, "rb", "c_custkey", None, existing, stored, phases,
                           as_of=F.lit(IMMEDIATE_AS_OF).cast("timestamp_ntz"), data_columns=["c_custkey", "c_mktsegment"])
    when = F.date_format("batch_start_time", "yyyy-MM-dd HH:mm:ss").alias("batch_time")
    batches = out["new_batches"].select("batch_id", when, "n_members")
    members = out["new_members"].join(batches, "batch_id").select(
        F.lit("member").alias("kind"), "member_key", "batch_time", "data_json")
    return members.unionByName(batches.select(F.lit("batch").alias("kind"), F.col("n_members").cast("string").alias("member_key"),
                                              "batch_time", F.lit(None).cast("string").alias("data_json")))


@register("active_members", sql="""
SELECT l_orderkey AS batch_id, COUNT(*) AS n_active_members
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
""")
def active_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active members per batch (lines of an order; returned = removed)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("removed")).otherwise(F.lit("active")).alias("status"))
    return M.active_member_counts(li, "batch_id", "status")
