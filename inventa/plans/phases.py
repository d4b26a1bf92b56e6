"""Phase and step progression on the provided tables.

Roles: an order is a batch (start = order date) or a phase; its line items are
members or steps.  Step status comes from the line flags:
F and not R → succeeded, F and R → failed, O and N → pending, else dispatched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.functions import durations as D
from inventa.functions import jsonmap as J
from inventa.functions import templates as TP
from inventa.operators import phases as PH
from inventa.operators.phases import job_id
from inventa.plans.columns import OFFSET_SQL, PHASES_VALUES, RUNBOOK_PHASES, runbook_phases_col
from inventa.plans.registry import register
from inventa.session import table

TS_FMT = "yyyy-MM-dd HH:mm:ss"
AS_OF_DUE = "1998-06-01 00:00:00"

STEP_STATUS_SQL = """CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 'succeeded'
     WHEN l_linestatus = 'F' THEN 'failed'
     WHEN l_returnflag = 'N' THEN 'pending' ELSE 'dispatched' END"""
STEPS_SQL = f"SELECT *, {STEP_STATUS_SQL} AS status FROM lineitem"


def step_status():
    return (F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R"), F.lit("succeeded"))
             .when(F.col("l_linestatus") == "F", F.lit("failed"))
             .when(F.col("l_returnflag") == "N", F.lit("pending"))
             .otherwise(F.lit("dispatched")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("status", step_status())


def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending phase executions: every order × the runbook phases with a valid offset."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = o.select("o_orderkey", "o_orderdate", F.explode(runbook_phases_col()).alias("p"))
    mins = F.col("p.offset_minutes")
    return (p.select(F.col("o_orderkey").alias("batch_id"), F.col("p.phase_name").alias("phase_name"),
                     D.due_at("o_orderdate", mins).alias("due_at"), F.lit("pending").alias("status"),
                     mins.alias("offset_minutes"))
            .filter(F.col("offset_minutes").isNotNull()))


PHASE_ROWS_SQL = f"""SELECT o.o_orderkey AS batch_id, p.phase_name,
  o.o_orderdate - to_minutes(CAST({OFFSET_SQL.format(o='p.off')} AS BIGINT)) AS due_at
FROM orders o, (VALUES {PHASES_VALUES}) p(phase_name, off, phase_index)
WHERE ({OFFSET_SQL.format(o='p.off')}) IS NOT NULL"""


@register("due_phases", sql=f"""
WITH p AS ({PHASE_ROWS_SQL}),
     m AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT p.batch_id, p.phase_name, strftime(p.due_at, '%Y-%m-%d %H:%M:%S') AS due_at, m.n AS n_members
FROM p JOIN m ON p.batch_id = m.l_orderkey
WHERE p.due_at <= TIMESTAMP '{AS_OF_DUE}'
""")
def due_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending phases due at ``as_of`` with their active-member
    count; a phase without active members is not emitted."""
    due = PH.pending_and_due(phase_rows(spark, sf_dir), F.lit(AS_OF_DUE).cast("timestamp_ntz"))
    members = (table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "O")
               .groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_members")))
    return due.join(members, "batch_id").select(
        "batch_id", "phase_name", F.date_format("due_at", TS_FMT).alias("due_at"), "n_members")


STEP_NAMES = ("validate", "migrate", "verify")


@register("step_expansion", sql=f"""
SELECT l_orderkey, l_linenumber, s.idx AS step_index, s.name AS step_name,
       'step-' || CAST(l_orderkey * 1000 + l_linenumber * 10 + s.idx AS VARCHAR)
         || CASE WHEN l_returnflag = 'R' AND s.idx > 0 THEN '-retry-' || CAST(s.idx AS VARCHAR) ELSE '' END AS job_id
FROM lineitem, (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(STEP_NAMES))}) s(idx, name)
""")
def step_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (line items) × the phase's steps with their index
    and job id (``-retry-n`` for returned lines)."""
    li = table(spark, sf_dir, "lineitem")
    x = PH.with_step_index(li, F.array(*[F.lit(n) for n in STEP_NAMES]))
    step_id = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.col("step_index")
    retry = F.when(F.col("l_returnflag") == "R", F.col("step_index")).otherwise(F.lit(0))
    return x.select("l_orderkey", "l_linenumber", "step_index", F.col("step").alias("step_name"),
                    job_id(step_id, retry=retry).alias("job_id"))


@register("next_step", sql=f"""
WITH s AS ({STEPS_SQL}),
     f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, status,
                  row_number() OVER (PARTITION BY l_orderkey
                                     ORDER BY l_linenumber, l_partkey, l_suppkey, status) AS rn
           FROM s WHERE status <> 'succeeded')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM f WHERE rn = 1 AND status = 'pending'
""")
def next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per member (order) the next dispatchable step (line)."""
    return PH.next_dispatchable_step(steps(spark, sf_dir), ["l_orderkey"],
                                     ["l_linenumber", "l_partkey", "l_suppkey"])


PHASE_ROLLUP_SQL = f"""
WITH s AS ({STEPS_SQL}),
     m AS (SELECT l_orderkey, l_suppkey, bool_and(status = 'succeeded') AS ok,
                  bool_or(status IN ('pending', 'dispatched', 'polling')) AS op
           FROM s GROUP BY 1, 2),
     p AS (SELECT l_orderkey, bool_or(ok) AS ok, bool_or(op) AS op FROM m GROUP BY 1)
SELECT o.o_orderkey AS phase_id, o.o_custkey AS batch_id,
       CASE WHEN p.l_orderkey IS NULL THEN 'completed' WHEN p.op THEN 'in_progress'
            WHEN p.ok THEN 'completed' ELSE 'failed' END AS phase_status
FROM orders o LEFT JOIN p ON o.o_orderkey = p.l_orderkey"""


def _phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PH.phase_outcome(steps(spark, sf_dir).withColumnRenamed("l_orderkey", "phase_id"),
                           ["phase_id"], ["l_suppkey"])
    phases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("phase_id"),
                                                   F.col("o_custkey").alias("batch_id"))
    return PH.with_empty_phases(phases.select("phase_id"), out, ["phase_id"]).join(phases, "phase_id")


@register("phase_rollup", sql=f"SELECT phase_id, phase_status FROM ({PHASE_ROLLUP_SQL})")
def phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase (order) outcome from its members' (suppliers') steps."""
    return _phase_rollup(spark, sf_dir).select("phase_id", "phase_status")


@register("batch_rollup", sql=f"""
SELECT batch_id,
       CASE WHEN bool_or(phase_status IN ('pending', 'dispatched', 'in_progress')) THEN 'in_progress'
            WHEN bool_or(phase_status = 'completed') THEN 'completed' ELSE 'failed' END AS batch_status
FROM ({PHASE_ROLLUP_SQL}) GROUP BY 1
""")
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: batch (customer) outcome from its phases (orders)."""
    return PH.batch_outcome(_phase_rollup(spark, sf_dir), ["batch_id"])


MANUAL_PHASES_SQL = """SELECT o_custkey AS batch_id, o_orderkey,
  CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') * 1440 AS BIGINT) AS offset_minutes,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'dispatched' ELSE 'completed' END AS status
FROM orders"""


def manual_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("batch_id"), "o_orderkey",
                    (F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
                     .cast("bigint") * 1440).alias("offset_minutes"),
                    F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "dispatched")
                    .otherwise("completed").alias("status"))


FIRST_NEXT_SQL = f"""
WITH p AS ({MANUAL_PHASES_SQL}),
     f AS (SELECT batch_id, offset_minutes AS f_off, o_orderkey AS f_key FROM (
             SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY offset_minutes, o_orderkey) AS rn
             FROM p WHERE status = 'pending') WHERE rn = 1),
     n AS (SELECT batch_id, off AS n_off, k AS n_key FROM (
             SELECT p.batch_id, p.offset_minutes AS off, p.o_orderkey AS k,
                    row_number() OVER (PARTITION BY p.batch_id ORDER BY p.offset_minutes, p.o_orderkey) AS rn
             FROM p JOIN f ON p.batch_id = f.batch_id
             WHERE p.status = 'pending' AND p.offset_minutes > f.f_off) WHERE rn = 1),
     b AS (SELECT DISTINCT p.batch_id FROM p JOIN f ON p.batch_id = f.batch_id
           WHERE p.status = 'dispatched' AND p.offset_minutes < f.f_off)
SELECT f.batch_id, f.f_off AS first_offset_minutes, f.f_key AS first_o_orderkey,
       n.n_off AS next_offset_minutes, n.n_key AS next_o_orderkey, b.batch_id IS NOT NULL AS blocked
FROM f LEFT JOIN n ON f.batch_id = n.batch_id LEFT JOIN b ON f.batch_id = b.batch_id"""


@register("first_next_phase", sql=FIRST_NEXT_SQL)
def first_next_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch (customer) the first pending phase (order) by
    offset ascending, the next pending one of greater offset, and whether a
    phase of smaller offset is still dispatched."""
    found = PH.first_and_next_phase(manual_phases(spark, sf_dir), ["batch_id"], ["offset_minutes", "o_orderkey"])
    return found.filter(F.col("first_o_orderkey").isNotNull()).drop("in_progress")


@register("manual_advance", sql=f"""
WITH x AS ({FIRST_NEXT_SQL}),
     bt AS (SELECT batch_id, bool_or(status = 'dispatched') AS running FROM ({MANUAL_PHASES_SQL}) GROUP BY 1)
SELECT bt.batch_id,
       CASE WHEN c.c_acctbal < 0 THEN 'dispatch_init'
            WHEN c.c_acctbal < 1000 THEN 'wait_init'
            WHEN x.batch_id IS NULL AND bt.running THEN 'wait'
            WHEN x.batch_id IS NULL THEN 'completed'
            WHEN x.blocked THEN 'wait' ELSE 'dispatch_phase' END AS decision
FROM bt JOIN customer c ON bt.batch_id = c.c_custkey LEFT JOIN x ON bt.batch_id = x.batch_id
""")
def manual_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The advance decision of a manual batch (init pending when the
    customer balance is negative, running when it is below 1000)."""
    phases = manual_phases(spark, sf_dir)
    fn = PH.first_and_next_phase(phases, ["batch_id"], ["offset_minutes", "o_orderkey"])
    batches = phases.select("batch_id").distinct()
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch_id"), "c_acctbal")
    x = batches.join(cust, "batch_id").join(fn, "batch_id", "left")
    return x.select("batch_id", PH.manual_advance_decision(
        F.col("c_acctbal") < 0, F.col("c_acctbal") < 1000, F.col("first_o_orderkey"), F.col("blocked"),
        F.col("in_progress")).alias("decision"))


@register("init_steps", sql=f"""
WITH s AS ({STEPS_SQL}),
     f AS (SELECT l_orderkey, min(l_linenumber) AS next_init_linenumber FROM s WHERE status = 'pending' GROUP BY 1)
SELECT o.o_orderkey AS batch_id, f.next_init_linenumber,
       CASE WHEN f.l_orderkey IS NULL THEN 'active' ELSE 'init_dispatched' END AS batch_status
FROM orders o LEFT JOIN f ON o.o_orderkey = f.l_orderkey
""")
def init_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next pending init step (line) per batch (order); a batch with
    no pending init step left becomes active."""
    nxt = (steps(spark, sf_dir).filter(F.col("status") == "pending")
           .groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.min("l_linenumber").alias("next_init_linenumber")))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"))
    x = b.join(nxt, "batch_id", "left")
    return x.select("batch_id", "next_init_linenumber",
                    F.when(F.col("next_init_linenumber").isNull(), F.lit("active"))
                    .otherwise(F.lit("init_dispatched")).alias("batch_status"))


@register("member_failure", sql=f"""
WITH s AS ({STEPS_SQL}),
     f AS (SELECT DISTINCT l_orderkey FROM s WHERE status = 'failed')
SELECT l_orderkey, COUNT(*) FILTER (WHERE status IN ('pending', 'dispatched')) AS n_cancelled,
       COUNT(*) AS n_steps
FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM f) GROUP BY 1
""")
def member_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member (order) with a failed step has all its open steps
    cancelled."""
    s = steps(spark, sf_dir)
    failed = s.filter(F.col("status") == "failed").select("l_orderkey")
    after = PH.cancel_open_steps(s.withColumn("_was", F.col("status")), failed, ["l_orderkey"])
    hit = after.join(failed.distinct(), "l_orderkey", "left_semi")
    return hit.groupBy("l_orderkey").agg(
        F.count_if((F.col("status") == "cancelled") & (F.col("_was") != "cancelled")).alias("n_cancelled"),
        F.count(F.lit(1)).alias("n_steps"))


NEW_VERSION = 5
AS_OF_TRANSITION = "1999-01-01 00:00:00"


@register("version_transition", sql=f"""
WITH o AS (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS v FROM orders),
     b AS (SELECT o_custkey AS batch_id, max(o_orderdate) AS start,
                  COUNT(*) FILTER (WHERE v < {NEW_VERSION} AND o_orderstatus = 'O') AS n_superseded
           FROM o GROUP BY 1
           HAVING bool_or(v < {NEW_VERSION}) AND NOT bool_or(v = {NEW_VERSION})),
     p AS (SELECT * FROM (VALUES {PHASES_VALUES}) t(phase_name, off, phase_index)
           WHERE ({OFFSET_SQL.format(o='off')}) IS NOT NULL)
SELECT b.batch_id, p.phase_name,
       CASE WHEN b.start - to_minutes(CAST({OFFSET_SQL.format(o='p.off')} AS BIGINT)) <= TIMESTAMP '{AS_OF_TRANSITION}'
            THEN 'skipped' ELSE 'pending' END AS new_status,
       b.n_superseded
FROM b, p
""")
def version_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches (customers) with phases (orders) of older runbook
    versions (priority digit) and none of version 5 move to the new
    definition: new phases pending, or skipped when overdue in ``ignore``
    mode; old pending phases are superseded."""
    o = table(spark, sf_dir, "orders").withColumn("runbook_version",
                                                  F.substring("o_orderpriority", 1, 1).cast("int"))
    o = o.withColumnRenamed("o_custkey", "batch_id")
    moving = PH.version_transition(o, ["batch_id"], NEW_VERSION)
    info = o.groupBy("batch_id").agg(
        F.max("o_orderdate").alias("start"),
        F.count_if((F.col("runbook_version") < NEW_VERSION) & (F.col("o_orderstatus") == "O")).alias("n_superseded"))
    b = moving.join(info, "batch_id")
    x = b.select("*", F.explode(runbook_phases_col()).alias("p"))
    mins = F.col("p.offset_minutes")
    x = x.filter(mins.isNotNull())
    status = PH.new_phase_status(D.due_at("start", mins), F.lit(AS_OF_TRANSITION).cast("timestamp_ntz"),
                                 "ignore", F.lit(False))
    return x.select("batch_id", F.col("p.phase_name").alias("phase_name"), status.alias("new_status"), "n_superseded")


# Each runbook version's step template (version = order priority digit).
VERSION_TEMPLATES = {1: "move {{c_name}}", 2: "notify {{c_mktsegment}}", 3: "sync {{c_name}}/{{nation}}",
                     4: "check {{unknown_var}}", 5: "done {{c_custkey}}"}


@register("catch_up", sql=f"""
WITH m AS (SELECT * FROM customer),
     p AS (SELECT o_orderkey, o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS v
           FROM orders WHERE o_orderstatus IN ('P', 'F'))
SELECT m.c_custkey, p.o_orderkey, 1 AS step_index, 'confirm ' || m.c_name AS step_text
FROM m JOIN p ON m.c_custkey = p.o_custkey
UNION ALL
SELECT m.c_custkey, p.o_orderkey, 0,
  CASE p.v WHEN 1 THEN 'move ' || m.c_name WHEN 2 THEN 'notify ' || m.c_mktsegment
           WHEN 3 THEN 'sync ' || m.c_name || '/' || CAST(m.c_nationkey AS VARCHAR)
           WHEN 5 THEN 'done ' || CAST(m.c_custkey AS VARCHAR) END AS step_text
FROM m JOIN p ON m.c_custkey = p.o_custkey
WHERE p.v <> 4
""")
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member added late catches up on its batch's already
    dispatched/completed phases: every step of the phase, the first with the
    template of the phase's own runbook version; a step whose template does not
    resolve is skipped."""
    m = table(spark, sf_dir, "customer")
    p = (table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("P", "F"))
         .select("o_orderkey", F.col("o_custkey").alias("c_custkey"),
                 F.substring("o_orderpriority", 1, 1).cast("int").alias("v")))
    tmpl = F.create_map(*[x for k, t in VERSION_TEMPLATES.items() for x in (F.lit(k), F.lit(t))])
    data = F.map_concat(J.row_to_string_map(["c_custkey", "c_name", "c_mktsegment"]),
                        F.create_map(F.lit("_nation"), F.col("c_nationkey").cast("string")))
    steps = F.array(tmpl[F.col("v")], F.lit("confirm {{c_name}}"))
    x = (m.join(p, "c_custkey").select("*", F.posexplode(steps).alias("step_index", "_t"))
         .withColumn("_e", TP.expand(F.col("_t"), data)))
    return (x.filter(F.size("_e.unresolved") == 0)
            .select("c_custkey", "o_orderkey", "step_index", F.col("_e.text").alias("step_text")))


# The phase's steps: (name, parameter template).
DUE_STEPS = (("create_mailbox", "New-Mailbox -Name {{c_name}}"),
             ("set_segment", "Set-Segment {{c_mktsegment}} -Batch {{_batch_id}}"),
             ("notify", "Send-Mail {{manager_email}}"))


@register("phase_due_steps", sql="""
SELECT c_custkey, s.idx AS step_index, s.name AS step_name,
       CASE WHEN s.idx = 2 AND NOT (c_acctbal > 0) THEN 'failed' ELSE 'pending' END AS status,
       CASE s.idx WHEN 0 THEN 'New-Mailbox -Name ' || c_name
                  WHEN 1 THEN 'Set-Segment ' || c_mktsegment || ' -Batch ' || CAST(c_nationkey AS VARCHAR)
                  ELSE CASE WHEN c_acctbal > 0 THEN 'Send-Mail ' || lower(c_name) || '@mgr.com' END END AS params,
       CASE WHEN s.idx = 2 AND NOT (c_acctbal > 0) THEN 'unresolved: manager_email' END AS error
FROM customer, (VALUES (0, 'create_mailbox'), (1, 'set_segment'), (2, 'notify')) s(idx, name)
""")
def phase_due_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A due phase creates one step execution per member
    (customer, batch = nation) and step; parameters are expanded from the
    member's data; a step whose template does not resolve is created
    ``failed`` with the unresolved names (members without a manager)."""
    c = table(spark, sf_dir, "customer")
    data = F.map_filter(
        F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment"),
                     F.lit("manager_email"), F.concat(F.lower("c_name"), F.lit("@mgr.com"))),
        lambda k, v: (k != "manager_email") | (F.col("c_acctbal") > 0))
    steps = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("template")) for n, t in DUE_STEPS])
    x = PH.with_step_index(c.withColumn("_data", data), steps)
    e = TP.expand(F.col("step.template"), F.col("_data"), batch_id=F.col("c_nationkey"))
    bad = F.size(e.unresolved) > 0
    return x.select("c_custkey", "step_index", F.col("step.name").alias("step_name"),
                    F.when(bad, F.lit("failed")).otherwise(F.lit("pending")).alias("status"),
                    F.when(~bad, e.text).alias("params"),
                    F.when(bad, F.concat(F.lit("unresolved: "), F.array_join(e.unresolved, ","))).alias("error"))


REMOVAL_STEPS = ("remove_license", "notify_owner")


@register("member_removal", sql=f"""
WITH s AS ({STEPS_SQL}),
     rm AS (SELECT DISTINCT l_orderkey FROM s WHERE l_returnflag = 'R' AND l_linestatus = 'O'),
     c AS (SELECT l_orderkey, COUNT(*) FILTER (WHERE status IN ('pending', 'dispatched')) AS n_cancelled
           FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM rm) GROUP BY 1)
SELECT c.l_orderkey, r.idx AS step_index, r.name AS step_name, 'pending' AS status, c.n_cancelled
FROM c, (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(REMOVAL_STEPS))}) r(idx, name)
""")
def member_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A removed member (an order with a returned open line) has its
    open steps (lines) cancelled and gets one pending execution per
    ``on_member_removed`` step."""
    s = steps(spark, sf_dir)
    removed = s.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).select("l_orderkey").distinct()
    after = PH.cancel_open_steps(s.withColumn("_was", F.col("status")), removed, ["l_orderkey"])
    cancelled = (after.join(removed, "l_orderkey", "left_semi").groupBy("l_orderkey")
                 .agg(F.count_if((F.col("status") == "cancelled") & (F.col("_was") != "cancelled")).alias("n_cancelled")))
    emitted = PH.removal_steps(removed, ["l_orderkey"], REMOVAL_STEPS)
    return emitted.join(cancelled, "l_orderkey").select("l_orderkey", "step_index", "step_name", "status",
                                                        "n_cancelled")
