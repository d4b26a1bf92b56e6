"""Worker results, polling and retries; device check-ins; listings.

Roles: events are step results / device check-ins (step = user, kind from
event type: purchase = success, error = failure, view = polling, others =
heartbeat); orders are batches listed for the admin view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.functions import durations as D
from inventa.functions.text import upn_domain
from inventa.operators import listing as L
from inventa.operators import result_fold as RF
from inventa.operators import results as RS
from inventa.operators import transitions as TR
from inventa.plans.registry import register
from inventa.session import scratch_path, table

TS_FMT = "yyyy-MM-dd HH:mm:ss"
AS_OF_POLL = "2024-01-15 00:00:00"


@register("poll_retry", sql=f"""
WITH s AS (SELECT event_id, ts, user_id, value, event_type FROM events WHERE ts <= TIMESTAMP '{AS_OF_POLL}')
SELECT event_id,
  CASE WHEN event_type = 'view' THEN
         CASE WHEN date_diff('second', ts, TIMESTAMP '{AS_OF_POLL}') > 86400 THEN 'poll_timeout'
              WHEN ts + to_minutes(CAST(value AS BIGINT)) + INTERVAL 900 SECOND <= TIMESTAMP '{AS_OF_POLL}' THEN 'poll_due'
              ELSE 'wait' END
       WHEN event_type = 'error' THEN
         CASE WHEN user_id % 4 < COALESCE(CASE WHEN value > 10 THEN 2 END, 3) THEN 'retry' ELSE 'fail' END
  END AS action,
  CASE WHEN event_type = 'error' AND user_id % 4 < COALESCE(CASE WHEN value > 10 THEN 2 END, 3)
       THEN strftime(TIMESTAMP '{AS_OF_POLL}' + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S') END AS retry_after
FROM s WHERE event_type IN ('view', 'error')
""")
def poll_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polling steps (views) — timeout after 1d, poll due
    every 15m after the last poll (ts + value minutes); failed steps
    (errors) retry while under their limit (step limit 2 when value > 10,
    else global 3), retry_after = as_of + 5m."""
    as_of = F.lit(AS_OF_POLL).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").filter((F.col("ts") <= as_of) & F.col("event_type").isin("view", "error"))
    status = F.when(F.col("event_type") == "view", F.lit("polling")).otherwise(F.lit("failed"))
    last_polled = F.timestamp_add("MINUTE", F.col("value").cast("bigint"), F.col("ts"))
    poll = RS.poll_action(status, F.col("ts"), last_polled, as_of, "15m", "1d")
    retry = RS.retry_decision(F.col("user_id") % 4, F.when(F.col("value") > 10, F.lit(2)), 3)
    action = F.when(F.col("event_type") == "view", poll).otherwise(retry)
    retry_after = F.when((F.col("event_type") == "error") & (retry == "retry"),
                         F.date_format(F.timestamp_add("SECOND", D.duration_seconds(F.lit("5m")), as_of), TS_FMT))
    return e.select("event_id", action.alias("action"), retry_after.alias("retry_after"))


RESULT_KIND_SQL = """CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure'
     WHEN 'view' THEN 'polling' ELSE 'heartbeat' END"""


@register("result_reducer", sql=f"""
WITH r AS (SELECT user_id, ts, event_id, {RESULT_KIND_SQL} AS kind FROM events),
     f AS (SELECT user_id, ts, event_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
           FROM r WHERE kind = 'failure'),
     ok AS (SELECT user_id, arg_min(ts, (ts, event_id)) AS ok_ts, arg_min(event_id, (ts, event_id)) AS ok_id
            FROM r WHERE kind = 'success' GROUP BY 1),
     bad AS (SELECT user_id, ts AS bad_ts, event_id AS bad_id FROM f WHERE n = 3),
     t AS (SELECT u.user_id, ok.ok_ts, ok.ok_id, bad.bad_ts, bad.bad_id,
                  CASE WHEN ok.ok_ts IS NULL THEN bad.bad_ts WHEN bad.bad_ts IS NULL THEN ok.ok_ts
                       WHEN (ok.ok_ts, ok.ok_id) < (bad.bad_ts, bad.bad_id) THEN ok.ok_ts ELSE bad.bad_ts END AS t_ts,
                  CASE WHEN ok.ok_ts IS NULL THEN bad.bad_id WHEN bad.bad_ts IS NULL THEN ok.ok_id
                       WHEN (ok.ok_ts, ok.ok_id) < (bad.bad_ts, bad.bad_id) THEN ok.ok_id ELSE bad.bad_id END AS t_id
           FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN ok USING (user_id) LEFT JOIN bad USING (user_id)),
     l AS (SELECT r.*, t.t_ts, t.t_id, t.ok_id,
                  t.t_ts IS NOT NULL AND (r.ts > t.t_ts OR (r.ts = t.t_ts AND r.event_id > t.t_id)) AS after
           FROM r JOIN t USING (user_id)),
     last AS (SELECT user_id, arg_max(kind, (ts, event_id)) AS last_kind FROM l
              WHERE NOT after AND kind <> 'heartbeat' GROUP BY 1)
SELECT l.user_id,
  CASE WHEN any_value(l.t_id) IS NOT NULL AND any_value(l.t_id) = any_value(l.ok_id) THEN 'succeeded'
       WHEN any_value(l.t_id) IS NOT NULL THEN 'failed'
       WHEN any_value(last.last_kind) = 'failure' THEN 'retry_pending'
       WHEN any_value(last.last_kind) = 'polling' THEN 'polling' ELSE 'dispatched' END AS final_status,
  COUNT(*) FILTER (WHERE NOT l.after AND l.kind <> 'heartbeat') AS n_applied,
  COUNT(*) FILTER (WHERE l.after) AS n_ignored
FROM l LEFT JOIN last USING (user_id) GROUP BY l.user_id
""")
def result_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold each step's (user's) results in time order; results
    after the terminal one are ignored; the third failure is terminal."""
    e = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure")
             .when(F.col("event_type") == "view", "polling").otherwise("heartbeat"))
    return RS.reduce_results(e.withColumn("kind", kind), ["user_id"], ["ts", "event_id"], "kind", max_retries=2)


@register("result_outputs", sql="""
WITH last_ok AS (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events
                 WHERE event_type = 'purchase' GROUP BY 1)
SELECT c.c_custkey AS member_id, c.c_mktsegment AS segment,
       CAST(json_extract(l.props, '$.k') AS VARCHAR) AS mailbox_guid,
       l.user_id IS NULL AS output_missing
FROM customer c LEFT JOIN last_ok l ON c.c_custkey = l.user_id
""")
def result_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's latest successful result (a purchase;
    the field name's case varies) yields output parameter ``MailboxGuid ←
    k``, merged into the member's worker data (worker wins); members with no
    result get a warning flag."""
    from inventa.functions import jsonmap as J
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    # half of the results spell the field ``K``: the lookup is case-insensitive
    result = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", '"k"', '"K"')).otherwise(F.col("props"))
    last = e.groupBy("user_id").agg(F.max_by(result, F.struct("ts", "event_id")).alias("result"))
    c = table(spark, sf_dir, "customer")
    x = c.join(last, c.c_custkey == last.user_id, "left")
    worker = F.when(F.col("result").isNotNull(),
                    F.create_map(F.lit("MailboxGuid"), J.json_field_ci(F.col("result"), F.lit("k"))))
    member = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    merged = J.merge_worker_data(member, F.coalesce(worker, F.create_map().cast("map<string,string>")))
    return x.select(F.col("c_custkey").alias("member_id"), merged["segment"].alias("segment"),
                    merged["MailboxGuid"].alias("mailbox_guid"), F.col("result").isNull().alias("output_missing"))


@register("migration_progress", sql="""
SELECT lower(c_mktsegment) || '.example.com' AS domain, COUNT(*) AS n_devices,
       COUNT(*) FILTER (WHERE c_acctbal > 5000) AS n_migrated
FROM customer GROUP BY 1
""")
def migration_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration progress by UPN domain."""
    c = table(spark, sf_dir, "customer")
    upn = F.concat(F.col("c_name"), F.lit("@"), F.col("c_mktsegment"), F.lit(".example.com"))
    return c.groupBy(upn_domain(upn).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_devices"), F.count_if(F.col("c_acctbal") > 5000).alias("n_migrated"))


AS_OF_CHECKIN = "2024-01-15 12:00:00"


@register("checkin_activity", sql=f"""
SELECT event_type AS domain, COUNT(*) AS n_checkins,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM events WHERE ts > TIMESTAMP '{AS_OF_CHECKIN}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF_CHECKIN}'
GROUP BY 1
""")
def checkin_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check-ins per domain in the hour before ``as_of``."""
    as_of = F.lit(AS_OF_CHECKIN).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").filter(
        (F.col("ts") > F.timestamp_add("HOUR", F.lit(-1), as_of)) & (F.col("ts") <= as_of))
    return e.groupBy(F.col("event_type").alias("domain")).agg(
        F.count(F.lit(1)).alias("n_checkins"), F.date_format(F.min("ts"), TS_FMT).alias("first_seen"),
        F.date_format(F.max("ts"), TS_FMT).alias("last_seen"))


@register("device_summary", sql="""
SELECT COUNT(DISTINCT user_id) AS n_checked_in,
       COUNT(DISTINCT user_id) FILTER (WHERE value > 10) AS n_signalled,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_results,
       COUNT(DISTINCT user_id) FILTER (WHERE value > 10 AND user_id NOT IN
             (SELECT user_id FROM events WHERE event_type = 'purchase')) AS n_signalled_without_result
FROM events
""")
def device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device totals — checked in, signalled, results, signalled
    without any result."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.bool_or(F.col("value") > 10).alias("sig"),
                                   F.count_if(F.col("event_type") == "purchase").alias("res"))
    return per.agg(F.count(F.lit(1)).alias("n_checked_in"), F.count_if("sig").alias("n_signalled"),
                   F.sum("res").alias("n_results"),
                   F.count_if(F.col("sig") & (F.col("res") == 0)).alias("n_signalled_without_result"))


@register("checkin_upsert", sql="""
WITH s AS (SELECT user_id, event_type, COUNT(*) AS check_in_count,
                  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_check_in,
                  arg_max(value, (ts, value)) AS last_value
           FROM events GROUP BY 1, 2)
SELECT s.*, COALESCE(c.c_acctbal > 5000, false) AS is_migrated
FROM s LEFT JOIN customer c ON s.user_id = c.c_custkey
""")
def checkin_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status row per (user, device type), kept by the check-in
    stream over several micro-batches (late ones among them, as files are in
    hash order): count, last check-in, last value, and the migration flag
    looked up by user."""
    from inventa.sources.tables import VersionedTable
    from inventa.streaming.reducers import checkin_stream
    base = scratch_path(spark, "checkins")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    e.repartition(4, F.col("user_id"), F.col("ts")).write.parquet(f"{base}/landed")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed")
    status = VersionedTable(spark, f"{base}/status", ["user_id", "event_type"], ["last_check_in"], buckets=4)
    checkin_stream(spark, stream, status, ["user_id", "event_type"], "ts", "value", f"{base}/ckpt")
    s = status.read().select("user_id", "event_type", "check_in_count",
                             F.date_format("last_check_in", TS_FMT).alias("last_check_in"), "last_value")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return (s.join(c, "user_id", "left")
            .withColumn("is_migrated", F.coalesce(F.col("c_acctbal") > 5000, F.lit(False))).drop("c_acctbal"))


@register("list_batches", sql="""
WITH m AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT o.o_orderkey AS batch_id, COALESCE(c.c_mktsegment, 'unknown') AS runbook_name,
       CAST(left(o.o_orderpriority, 1) AS INTEGER) AS runbook_version, COALESCE(m.n, 0) AS member_count,
       strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS detected_at
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN m ON o.o_orderkey = m.l_orderkey
WHERE o.o_orderstatus = 'O'
ORDER BY o.o_orderdate DESC, o.o_orderkey DESC OFFSET 20 LIMIT 100
""")
def list_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin batch list — optional status filter, runbook name
    ('unknown' when missing) and active member count, newest first, page 2."""
    o = L.apply_filters(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=None)
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    x = o.join(c, o.o_custkey == c.c_custkey, "left").join(m, o.o_orderkey == m.l_orderkey, "left")
    x = x.select(F.col("o_orderkey").alias("batch_id"),
                 F.coalesce("c_mktsegment", F.lit("unknown")).alias("runbook_name"),
                 F.substring("o_orderpriority", 1, 1).cast("int").alias("runbook_version"),
                 F.coalesce("n", F.lit(0)).alias("member_count"), "o_orderdate")
    pg = L.page(x, [F.col("o_orderdate").desc(), F.col("batch_id").desc()], offset=20, limit=100)
    return pg.select("batch_id", "runbook_name", "runbook_version", "member_count",
                     F.date_format("o_orderdate", TS_FMT).alias("detected_at"))


AS_OF_WAVE = "1998-01-01 00:00:00"


@register("wave_query", sql=f"""
SELECT o.o_orderkey AS wave_id, c.c_name AS user_principal_name, strftime(o.o_orderdate, '%Y-%m-%d') AS wave_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate BETWEEN TIMESTAMP '{AS_OF_WAVE}' AND TIMESTAMP '{AS_OF_WAVE}' + INTERVAL 6 DAY
  AND o.o_orderstatus = 'O'
""")
def wave_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of approved waves dated within the next 6 days."""
    as_of = F.lit(AS_OF_WAVE).cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").filter(
        F.col("o_orderdate").between(as_of, F.timestamp_add("DAY", F.lit(6), as_of)) & (F.col("o_orderstatus") == "O"))
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("wave_id"), F.col("c_name").alias("user_principal_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("wave_date"))


@register("pending_queue", sql="""
SELECT o_orderkey AS request_id, o_custkey AS group_id, o_orderpriority AS priority
FROM orders WHERE o_orderstatus = 'P'
""")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending remediation queue (filter + rename)."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("group_id"),
                    F.col("o_orderpriority").alias("priority"))


@register("active_filters", sql="""
SELECT o.o_orderkey AS batch_id, c.c_custkey AS member_id, n.n_name AS nation
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_orderstatus NOT IN ('F') AND r.r_name = 'ASIA'
""")
def active_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active batches (not completed/failed) of one runbook
    (region) through a 4-way inner join."""
    o = table(spark, sf_dir, "orders").withColumn(
        "status", F.when(F.col("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("active")))
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region").filter(F.col("r_name") == "ASIA")
    x = (L.active_only(o).join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    return x.select(F.col("o_orderkey").alias("batch_id"), F.col("c_custkey").alias("member_id"),
                    F.col("n_name").alias("nation"))


@register("top_active", sql="""
SELECT o_orderkey AS batch_id, strftime(o_orderdate, '%Y-%m-%d') AS detected_at
FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1
""")
def top_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2/O3: the most recent active batch (TOP 1, multi-key order)."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "F")
    t = L.top1(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return t.select(F.col("o_orderkey").alias("batch_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("detected_at"))


def _requests_sql() -> tuple[str, str]:
    """Requests of the five entity kinds from events, by the declared transitions."""
    kinds = list(TR.TRANSITIONS)
    whens = []
    for i, kind in enumerate(kinds):
        names = list(TR.TRANSITIONS[kind])
        pick = " ".join(f"WHEN {j} THEN '{n}'" for j, n in enumerate(names))
        whens.append(f"WHEN {i} THEN CASE event_id % {len(names) + 1} {pick} ELSE 'unknown' END")
    return (f"CASE user_id % 5 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(kinds))} END",
            f"CASE user_id % 5 {' '.join(whens)} END")


_KIND, _REQUEST = _requests_sql()
_STATUS = ("CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'dispatched' WHEN 2 THEN 'pending' "
           "WHEN 3 THEN 'detected' ELSE 'active' END")
_STORED_KIND = _KIND.replace("user_id", "c_custkey")
_RULES = ", ".join(f"('{k}', '{n}', '{s}', '{to}')" for k, names in TR.TRANSITIONS.items() for n, (_, to) in names.items()
                   for s in TR.expected(k, n))


@register("guarded_transitions", sql=f"""
WITH RECURSIVE rules(kind, request, status, target) AS (VALUES {_RULES}),
q AS (SELECT {_KIND} AS kind, user_id AS id, {_REQUEST} AS request, ts,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
cur AS (SELECT {_STORED_KIND} AS kind, c_custkey AS id, {_STATUS} AS status FROM customer WHERE c_custkey % 11 <> 3),
walk(kind, id, n, status, request, ts, applied) AS (
  SELECT kind, id, 0::BIGINT, coalesce(status, 'absent'), NULL::VARCHAR, NULL::TIMESTAMP, NULL::BOOLEAN
  FROM (SELECT DISTINCT kind, id FROM q) LEFT JOIN cur USING (kind, id)
  UNION ALL
  SELECT w.kind, w.id, q.n, coalesce(r.target, w.status), q.request, q.ts, r.target IS NOT NULL
  FROM walk w JOIN q ON q.kind = w.kind AND q.id = w.id AND q.n = w.n + 1
  LEFT JOIN rules r ON r.kind = w.kind AND r.request = q.request AND r.status = w.status)
SELECT kind, id, arg_max(status, n) AS status, count(*) FILTER (WHERE applied) AS n_applied,
       count(*) FILTER (WHERE NOT applied) AS n_refused, count(*) FILTER (WHERE applied AND request = 'set_retry_pending') AS n_retries,
       strftime(arg_max(ts, n) FILTER (WHERE applied AND request IN ('set_dispatched', 'set_init_dispatched')), '%Y-%m-%d %H:%M:%S') AS dispatched_at,
       strftime(min(ts) FILTER (WHERE applied AND request = 'set_polling'), '%Y-%m-%d %H:%M:%S') AS poll_started_at,
       strftime(max(ts) FILTER (WHERE applied AND request = 'set_polling'), '%Y-%m-%d %H:%M:%S') AS last_polled_at
FROM walk GROUP BY kind, id
""")
def guarded_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to steps, inits, phases, batches and members (one entity per
    user, its requests from the user's events in time order) folded over their
    stored statuses; each request meets what the earlier ones left."""
    e = table(spark, sf_dir, "events")
    requests = e.select(F.expr(_KIND).alias("kind"), F.col("user_id").alias("id"), F.expr(_REQUEST).alias("request"), "ts", "event_id")
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 3")
    current = c.select(F.expr(_STORED_KIND).alias("kind"), F.col("c_custkey").alias("id"), F.expr(_STATUS).alias("status"))
    done = TR.advance(TR.outcomes(current, requests, ["id"], ["ts", "event_id"]), ["id"], ["ts", "event_id"], "ts")
    return done.select("kind", "id", "status", "n_applied", "n_refused", "n_retries", *[
        F.date_format(c, TS_FMT).alias(c) for c in ("dispatched_at", "poll_started_at", "last_polled_at")])


@register("result_retry_limits", sql="""
WITH RECURSIVE r AS (
  SELECT user_id, user_id % 5 AS most,
         CASE event_type WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'success' ELSE 'heartbeat' END WHEN 'error' THEN 'failure'
              WHEN 'view' THEN 'polling' ELSE 'heartbeat' END AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, n, status, failures, applied, ignored) AS (
  SELECT DISTINCT user_id, 0::BIGINT, CASE WHEN user_id % 7 = 0 THEN 'retry_pending' ELSE 'dispatched' END,
         CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END, 0::BIGINT, 0::BIGINT FROM r
  UNION ALL
  SELECT w.user_id, r.n,
         CASE WHEN w.status IN ('succeeded', 'failed') THEN w.status WHEN kind = 'success' THEN 'succeeded'
              WHEN kind = 'failure' THEN CASE WHEN w.failures + 1 > most THEN 'failed' ELSE 'retry_pending' END
              WHEN kind = 'polling' THEN 'polling' ELSE w.status END,
         w.failures + CASE WHEN w.status NOT IN ('succeeded', 'failed') AND kind = 'failure' THEN 1 ELSE 0 END,
         w.applied + CASE WHEN w.status NOT IN ('succeeded', 'failed') AND kind <> 'heartbeat' THEN 1 ELSE 0 END,
         w.ignored + CASE WHEN w.status IN ('succeeded', 'failed') THEN 1 ELSE 0 END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, arg_max(status, n) AS status, arg_max(failures, n)::INTEGER AS failures, max(applied) AS n_applied,
       max(ignored) AS n_ignored FROM walk GROUP BY user_id
""")
def result_retry_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of steps with a retry limit of their own (0 to 4), continued
    from stored states (every seventh step has failed once)."""
    e = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 60, "success").otherwise("heartbeat"))
            .when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "polling").otherwise("heartbeat"))
    results = e.select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("user_id") % 5).alias("most"))
    stored = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(
        F.col("c_custkey").alias("user_id"), F.lit("retry_pending").alias("status"), F.lit(1).alias("failures"),
        F.lit(0).cast("long").alias("n_applied"), F.lit(0).cast("long").alias("n_ignored"))
    return RF.fold_results(results, ["user_id"], ["ts", "event_id"], "kind", F.col("most"), stored)


@register("result_stream_ordered", sql="""
WITH RECURSIVE r AS (
  SELECT user_id, user_id % 5 AS most,
         CASE event_type WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'success' ELSE 'heartbeat' END WHEN 'error' THEN 'failure'
              WHEN 'view' THEN 'polling' ELSE 'heartbeat' END AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, n, status, failures, applied, ignored) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 'dispatched', 0, 0::BIGINT, 0::BIGINT FROM r
  UNION ALL
  SELECT w.user_id, r.n,
         CASE WHEN w.status IN ('succeeded', 'failed') THEN w.status WHEN kind = 'success' THEN 'succeeded'
              WHEN kind = 'failure' THEN CASE WHEN w.failures + 1 > most THEN 'failed' ELSE 'retry_pending' END
              WHEN kind = 'polling' THEN 'polling' ELSE w.status END,
         w.failures + CASE WHEN w.status NOT IN ('succeeded', 'failed') AND kind = 'failure' THEN 1 ELSE 0 END,
         w.applied + CASE WHEN w.status NOT IN ('succeeded', 'failed') AND kind <> 'heartbeat' THEN 1 ELSE 0 END,
         w.ignored + CASE WHEN w.status IN ('succeeded', 'failed') THEN 1 ELSE 0 END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT CAST(user_id AS VARCHAR) AS step_key, arg_max(status, n) AS status, arg_max(failures, n)::INTEGER AS failures,
       max(applied) AS n_applied, max(ignored) AS n_ignored FROM walk GROUP BY user_id
""")
def result_stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 on a stream in event order: results arrive in two parts, out of order
    by up to the whole month, and a last one moves the watermark past them; the
    stream is stopped and started again in between."""
    from inventa.streaming.processors import ordered_results_stream
    base = scratch_path(spark, "ordered_results")
    e = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 60, "success").otherwise("heartbeat"))
            .when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "polling").otherwise("heartbeat"))
    results = e.select(F.col("user_id").cast("string").alias("step"), F.col("ts").cast("timestamp").alias("ts"),
                       F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"),
                       (F.col("user_id") % 5).cast("int").alias("most"))
    last = results.agg(F.lit("closing").alias("step"), (F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"),
                       F.lit(0).cast("long").alias("event_id"), F.lit("heartbeat").alias("kind"), F.lit(0).alias("most"))
    later = F.col("kind").isin("failure", "success")
    for part in (results.where(~later), results.where(later), last):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(results.schema).parquet(f"{base}/in")
        (ordered_results_stream(stream, "step", "ts", "event_id", "kind", F.col("most"), watermark="45 days",
                                slice_ms=24 * 3_600_000)
         .writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    state = F.struct("status", "failures", "n_applied", "n_ignored")
    return (spark.read.parquet(f"{base}/out").where("step_key <> 'closing'").groupBy("step_key")
            .agg(F.max_by(state, "folded_to_ms").alias("s")).select("step_key", "s.*"))
