"""CSV intake, manifests, totals, enrichment and validation rules on the
provided tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inventa.functions.numeric import money_sum
from inventa.functions.text import EMPTY_GUID
from inventa.operators import constraints as CN
from inventa.operators import enrich as EN
from inventa.operators import listing as L
from inventa.operators import quality as Q
from inventa.operators.scd import merge_latest
from inventa.plans.registry import register
from inventa.session import scratch_path, table
from inventa.sources import csv_intake as CSV

CSV_KEY_SQL = """CASE WHEN c_custkey % 50 = 0 THEN ''
     WHEN c_custkey % 3 = 0 THEN 'u' || CAST(c_custkey % 700 AS VARCHAR)
     ELSE 'U' || CAST(c_custkey % 700 AS VARCHAR) END"""


@register("csv_validate", sql=f"""
WITH c AS (SELECT c_nationkey, c_custkey, {CSV_KEY_SQL} AS user_id,
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS rn FROM customer),
     k AS (SELECT *, lower(user_id) AS lk FROM c WHERE trim(user_id) <> ''),
     f AS (SELECT c_nationkey, lk, min(rn) AS mr FROM k GROUP BY 1, 2)
SELECT c_nationkey AS nation, rn AS row_number, 'empty_key' AS code, user_id AS key FROM c WHERE trim(user_id) = ''
UNION ALL
SELECT k.c_nationkey, k.rn, 'duplicate_key', k.user_id FROM k JOIN f USING (c_nationkey, lk) WHERE k.rn > f.mr
UNION ALL
SELECT DISTINCT c_nationkey, NULL, 'unexpected_column', 'name' FROM customer
""")
def csv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as one member CSV per nation (keys with
    blanks and case-insensitive repeats), read back with Spark's CSV
    reader and validated: empty keys, repeated keys (1-based file rows),
    unexpected columns."""
    path = scratch_path(spark, "csv")
    c = table(spark, sf_dir, "customer")
    key = (F.when(F.col("c_custkey") % 50 == 0, F.lit(""))
            .when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("u"), (F.col("c_custkey") % 700).cast("string")))
            .otherwise(F.concat(F.lit("U"), (F.col("c_custkey") % 700).cast("string"))))
    rows = c.select("c_nationkey", "c_custkey", key.alias("user_id"),
                    F.concat(F.lower("c_name"), F.lit("@x.com")).alias("email"), F.col("c_name").alias("name"))
    (rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey")
         .write.mode("overwrite").partitionBy("c_nationkey").option("header", "true").csv(path))
    df = CSV.read_member_csv(spark, path)
    member_cols = [x for x in df.columns if not x.startswith("_") and x != "c_nationkey"]
    warnings = [col for code, col in CSV.header_errors(member_cols, "user_id", ["user_id", "email"])
                if code == "unexpected_column"]
    bad = CSV.row_violations(df, "user_id").join(
        df.select("_file", "c_nationkey").distinct(), "_file")
    out = bad.select(F.col("c_nationkey").alias("nation"), F.col("_row").alias("row_number"), "code", "key")
    files = df.select("c_nationkey").distinct()
    for w in warnings:
        out = out.unionByName(files.select(F.col("c_nationkey").alias("nation"),
                                           F.lit(None).cast("long").alias("row_number"),
                                           F.lit("unexpected_column").alias("code"), F.lit(w).alias("key")))
    return out


GATE_ROWS, GATE_BYTES = 100, 7_500
GATE_KEY_SQL = """CASE WHEN c_custkey % 211 = 0 THEN '' WHEN c_custkey % 127 = 5 THEN 'u-' || CAST(c_custkey - 1 AS VARCHAR)
     ELSE 'U-' || CAST(c_custkey AS VARCHAR) END"""
#: ten uploads per 500 customers: the last has too many rows, the second too many bytes
GATE_UPLOAD_SQL = "CAST(floor(c_custkey / 500) * 10 + least(floor(c_custkey % 500 / 35), 9) AS BIGINT)"
GATE_MAIL_SQL = """lower(c_name) || '@' || CASE WHEN floor(c_custkey % 500 / 35) = 1 THEN repeat('d', 200) ELSE 'x' END || '.com'"""


@register("csv_intake_gate", sql=f"""
WITH c AS (SELECT {GATE_UPLOAD_SQL} AS upload, c_custkey, {GATE_KEY_SQL} AS user_id, {GATE_MAIL_SQL} AS email FROM customer),
f AS (SELECT upload, count(*) AS n, 14 + sum(CASE WHEN user_id = '' THEN 2 ELSE length(user_id) END + length(email) + 2) AS bytes,
             count(*) FILTER (WHERE trim(user_id) = '') AS blanks,
             count(*) FILTER (WHERE trim(user_id) <> '') - count(DISTINCT lower(user_id)) FILTER (WHERE trim(user_id) <> '') AS dups
      FROM c GROUP BY upload)
SELECT upload, c_custkey AS customer, user_id, email FROM (
  SELECT c.*, f.* EXCLUDE (upload) FROM c JOIN f USING (upload))
WHERE n <= {GATE_ROWS} AND bytes <= {GATE_BYTES} AND blanks = 0 AND dups = 0
""")
def csv_intake_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the rows that the upload gate lets through.  Customers are written as
    one member CSV per upload; files over the byte limit are left unparsed,
    files over the row limit or with an empty or repeated key go as a whole."""
    path = scratch_path(spark, "uploads")
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.expr(GATE_UPLOAD_SQL).alias("upload"), "c_custkey", F.expr(GATE_KEY_SQL.replace("VARCHAR", "STRING")).alias("user_id"),
                    F.expr(GATE_MAIL_SQL).alias("email"))
    (rows.repartition("upload").sortWithinPartitions("upload", "c_custkey").select("upload", "user_id", "email")
         .write.partitionBy("upload").option("header", "true").csv(path))
    taken, _ = CSV.intake(spark, path, "user_id", ["user_id", "email"], GATE_BYTES, GATE_ROWS)
    number = F.regexp_extract("email", "([0-9]+)@", 1).cast("long")
    return taken.select(F.col("upload").cast("long").alias("upload"), number.alias("customer"), "user_id", "email")


ROLE_TABLES = {
    "customer": CN.Constraints(("c_custkey", "c_name"), {"CK_segment": ("c_mktsegment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"))},
                               {"PK_customer": ("c_custkey",), "UQ_nation_segment": ("c_nationkey", "c_mktsegment")},
                               {"FK_customer_nation": ("c_nationkey", "nation", "n_nationkey")}),
    "orders": CN.Constraints(("o_orderkey",), {"CK_order_status": ("o_orderstatus", ("F", "O"))},
                             {"PK_orders": ("o_orderkey",), "UQ_customer_day": ("o_custkey", "o_orderdate")},
                             {"FK_order_customer": ("o_custkey", "customer", "c_custkey")}),
    "lineitem": CN.Constraints((), {"CK_flag": ("l_returnflag", ("A", "N"))}, {"PK_lineitem": ("l_orderkey", "l_linenumber")},
                               {"FK_line_order": ("l_orderkey", "orders", "o_orderkey")}),
}


@register("table_constraints", sql="""
WITH active AS (SELECT * FROM orders WHERE o_orderkey % 97 <> 0),
v AS (
  SELECT 'customer' AS "table", 'CK_segment' AS "constraint", c_mktsegment AS k1, NULL AS k2, count(*) AS n FROM customer
  WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY 3
  UNION ALL SELECT 'customer', 'UQ_nation_segment', c_nationkey::VARCHAR, c_mktsegment, count(*) FROM customer GROUP BY 3, 4 HAVING count(*) > 1
  UNION ALL SELECT 'customer', 'PK_customer', c_custkey::VARCHAR, NULL, count(*) FROM customer GROUP BY 3 HAVING count(*) > 1
  UNION ALL SELECT 'customer', 'FK_customer_nation', c_nationkey::VARCHAR, NULL, count(*) FROM customer
  WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 3
  UNION ALL SELECT 'orders', 'CK_order_status', o_orderstatus, NULL, count(*) FROM active WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 3
  UNION ALL SELECT 'orders', 'PK_orders', o_orderkey::VARCHAR, NULL, count(*) FROM active GROUP BY 3 HAVING count(*) > 1
  UNION ALL SELECT 'orders', 'UQ_customer_day', o_custkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), count(*) FROM active
  GROUP BY 3, 4 HAVING count(*) > 1
  UNION ALL SELECT 'orders', 'FK_order_customer', o_custkey::VARCHAR, NULL, count(*) FROM active
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 3
  UNION ALL SELECT 'lineitem', 'CK_flag', l_returnflag, NULL, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 3
  UNION ALL SELECT 'lineitem', 'PK_lineitem', l_orderkey::VARCHAR, l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 3, 4 HAVING count(*) > 1
  UNION ALL SELECT 'lineitem', 'FK_line_order', l_orderkey::VARCHAR, NULL, count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM active) GROUP BY 3)
SELECT * FROM v
""")
def table_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: domains, unique keys and references of three tables with roles like
    the tracker's (some orders are gone, so their lines refer to nothing)."""
    tables = {t: table(spark, sf_dir, t) for t in ("nation", "customer", "lineitem")}
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    tables["orders"] = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").withColumn("o_orderdate", day)
    found = CN.violations(tables, ROLE_TABLES)
    return found.select("table", "constraint", F.get_json_object("key", "$.c0").alias("k1"),
                        F.get_json_object("key", "$.c1").alias("k2"), "n")


MANIFEST_SQL = """
WITH x AS (SELECT 'run-' || CAST(year(l_shipdate) AS VARCHAR) AS run_id, 'tenant-' || l_returnflag AS tenant_key,
                  l_orderkey * 10 + l_linenumber AS item,
                  CASE WHEN l_linestatus = 'F' THEN 'processed' WHEN l_returnflag = 'A' THEN 'skipped'
                       ELSE 'failed' END AS st FROM lineitem),
     e AS (SELECT run_id, tenant_key,
                  string_agg('item ' || CAST(item AS VARCHAR) || ' failed', '; ' ORDER BY item) AS errs
           FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tenant_key ORDER BY item) AS rn
                 FROM x WHERE st = 'failed') WHERE rn <= 50 GROUP BY 1, 2)
SELECT x.run_id, x.tenant_key, 'lineitem' AS entity_type,
       COUNT(*) FILTER (WHERE st = 'processed') AS processed,
       COUNT(*) FILTER (WHERE st = 'skipped') AS skipped,
       COUNT(*) FILTER (WHERE st = 'failed') AS failed,
       any_value(e.errs) || CASE WHEN COUNT(*) FILTER (WHERE st = 'failed') > 50
                  THEN '; … ' || CAST(COUNT(*) FILTER (WHERE st = 'failed') - 50 AS VARCHAR) || ' more' ELSE '' END
         AS errors_text,
       CASE WHEN COUNT(*) FILTER (WHERE st = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
FROM x LEFT JOIN e USING (run_id, tenant_key) GROUP BY 1, 2
"""

MANIFEST_SCHEMA = ("run_id string, tenant_key string, entity_type string, processed long, skipped long, "
                   "failed long, errors array<string>, status string")


@register("manifest_totals", sql=MANIFEST_SQL)
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk outcomes (line items by ship year and flag) summed per
    (run, tenant, entity) into manifest records — processed, skipped,
    failed, the first 50 errors and '… n more' — written as JSON and read
    back."""
    li = table(spark, sf_dir, "lineitem")
    x = li.select(F.concat(F.lit("run-"), F.year("l_shipdate").cast("string")).alias("run_id"),
                  F.concat(F.lit("tenant-"), F.col("l_returnflag")).alias("tenant_key"),
                  (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
                  F.when(F.col("l_linestatus") == "F", "processed").when(F.col("l_returnflag") == "A", "skipped")
                  .otherwise("failed").alias("st"))
    keys = ["run_id", "tenant_key"]
    # first 50 failures per group: ranked window + filter = map-side group limit
    w = Window.partitionBy(*keys).orderBy("item")
    first = (x.filter(F.col("st") == "failed").withColumn("_rn", F.row_number().over(w)).filter("_rn <= 50")
             .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("item"))),
                                             lambda s: F.concat(F.lit("item "), s.item.cast("string"),
                                                                F.lit(" failed"))).alias("errors")))
    totals = x.groupBy(*keys).agg(F.count_if(F.col("st") == "processed").alias("processed"),
                                  F.count_if(F.col("st") == "skipped").alias("skipped"),
                                  F.count_if(F.col("st") == "failed").alias("failed"))
    manifest = (totals.join(first, keys, "left").withColumn("entity_type", F.lit("lineitem"))
                .withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")))
    path = scratch_path(spark, "manifests")
    manifest.write.mode("overwrite").json(path)
    m = spark.read.schema(MANIFEST_SCHEMA).json(path)
    more = F.when(F.col("failed") > 50, F.concat(F.lit("; … "), (F.col("failed") - 50).cast("string"),
                                                 F.lit(" more"))).otherwise(F.lit(""))
    text = F.when(F.col("errors").isNotNull(), F.concat(F.array_join("errors", "; "), more))
    return m.select("run_id", "tenant_key", "entity_type", "processed", "skipped", "failed",
                    text.alias("errors_text"), "status")


@register("progress_pct", sql="""
SELECT l_orderkey, COUNT(*) AS n_total,
       round(100.0 * (COUNT(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R')
                      + COUNT(*) FILTER (WHERE l_returnflag = 'R')) / COUNT(*), 1) AS pct_done
FROM lineitem GROUP BY 1
""")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """progress = (processed + failed) / total, one decimal."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R")).alias("_p"),
        F.count_if(F.col("l_returnflag") == "R").alias("_f"))
    return g.select("l_orderkey", "n_total",
                    F.round(F.lit(100.0) * (F.col("_p") + F.col("_f")) / F.col("n_total"), 1).alias("pct_done"))


@register("site_totals", sql="""
SELECT l_orderkey, COUNT(*) AS file_count, SUM(l_quantity) AS stream_size,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_size
FROM lineitem GROUP BY 1
""")
def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site (order): file count, stream size, total size."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("l_quantity").alias("stream_size"),
        money_sum("l_extendedprice").alias("total_size"))


def _part_work(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per-item work: skip large items, throttle expensive ones, else
    enrich (an upper-cased display name)."""
    skip = pdf["p_size"].to_numpy() > 45
    throttle = ~skip & (pdf["p_retailprice"].to_numpy() > 1950)
    ok = ~skip & ~throttle
    return pd.DataFrame({
        "p_partkey": pdf["p_partkey"],
        "ok": ok,
        "category": np.where(skip, "Skippable", np.where(throttle, "Throttle", None)),
        "error": np.where(skip, "item skipped", np.where(throttle, "Too many requests", None)),
        "enriched_name": pdf["p_name"].str.upper().where(ok, None),
        "p_size": pdf["p_size"],
    })


@register("enrichment", sql=f"""
WITH m AS (SELECT CAST(l_partkey AS VARCHAR) AS k, COUNT(*) AS n_managed FROM lineitem GROUP BY 1)
SELECT p_partkey, NOT (p_size > 45 OR p_retailprice > 1950) AS ok,
       CASE WHEN p_size > 45 THEN 'Skippable' WHEN p_retailprice > 1950 THEN 'Throttle' END AS category,
       CASE WHEN p_size > 45 THEN 'item skipped' WHEN p_retailprice > 1950 THEN 'Too many requests' END AS error,
       CASE WHEN NOT (p_size > 45 OR p_retailprice > 1950) THEN upper(p_name) END AS enriched_name,
       m.n_managed,
       CASE WHEN m.k IS NULL THEN 'Skipped' ELSE 'Enriched' END AS status,
       CASE WHEN p_size = 1 THEN 'no device id' WHEN m.k IS NULL THEN 'no managed device' END AS reason
FROM part LEFT JOIN m ON p_size <> 1 AND CAST(p_partkey AS VARCHAR) = m.k
""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-item work in ``mapInPandas`` with per-row outcomes, then
    the device ↔ managed-device join (all-zero ids never match)."""
    items = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    out = EN.enrich_items(items, _part_work, "enriched_name string, p_size int", ["p_partkey"])
    dev = out.withColumn("device_id", F.when(F.col("p_size") == 1, F.lit(EMPTY_GUID))
                         .otherwise(F.col("p_partkey").cast("string")))
    managed = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("k"))
               .agg(F.count(F.lit(1)).alias("n_managed")))
    x = EN.attach_managed(dev, managed, "device_id", "k")
    return x.select("p_partkey", "ok", "category", "error", "enriched_name", "n_managed", "status", "reason")


@register("folder_statistics", sql="""
SELECT o.o_orderkey AS mailbox_id, COUNT(*) AS n_folders, SUM(l.l_quantity) AS item_count
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY 1
""")
def folder_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder statistics (line items) carry their mailbox's id
    (orders) down, then roll up per mailbox."""
    mailboxes = table(spark, sf_dir, "orders")
    folders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mailbox_id"), "l_quantity")
    x = EN.copy_key_down(mailboxes, folders, "o_orderkey", "mailbox_id")
    return x.groupBy("mailbox_id").agg(F.count(F.lit(1)).alias("n_folders"), F.sum("l_quantity").alias("item_count"))


@register("expected_columns", sql=r"""
WITH v AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS column_name FROM part
           UNION ALL SELECT p_brand, '_batch_id' FROM part),
     c AS (SELECT p_brand, column_name FROM v WHERE NOT starts_with(column_name, '_') AND lower(column_name) NOT IN ('ring')
           UNION ALL SELECT p_brand, '_key' FROM part UNION ALL SELECT p_brand, 'migration_date' FROM part
           UNION ALL SELECT p_brand, 'Migration_Date' FROM part)
SELECT p_brand AS runbook, min(column_name) AS column_name FROM c GROUP BY p_brand, lower(column_name)
""")
def expected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns a member CSV must have per runbook (brand): key, batch
    time, every template variable of its steps, minus output parameters
    and built-ins."""
    p = table(spark, sf_dir, "part").withColumn(
        "tmpl", F.concat(F.lit("{{_batch_id}} {{"), F.regexp_replace("p_name", " ", "}} {{"), F.lit("}}")))
    cols = Q.expected_columns(p, "p_brand", "tmpl", F.lit("_key"), output_params=["ring"],
                              extra=["migration_date", "Migration_Date"])
    return cols.select(F.col("p_brand").alias("runbook"), "column_name")


@register("runbook_rules", sql="""
WITH s AS (SELECT p_brand, p_name, p_type, p_size, p_partkey,
                  'T-' || CAST(p_size - 25 AS VARCHAR) || 'd' AS off, lower(p_type) AS rb FROM part)
SELECT 'duplicate_step' AS rule, p_brand || '/' || lower(p_name) AS item, CAST(COUNT(*) AS VARCHAR) AS detail
FROM s GROUP BY p_brand, lower(p_name) HAVING COUNT(*) > 1
UNION ALL
SELECT 'missing_worker', p_brand || '/' || p_name, NULL FROM s WHERE p_partkey % 11 IN (0, 1)
UNION ALL
SELECT 'bad_offset', p_brand || '/' || p_name, off FROM s WHERE p_size <= 25
UNION ALL
SELECT 'missing_poll_timeout', p_brand || '/' || p_name, NULL FROM s WHERE p_size > 40 AND p_size % 4 = 0
UNION ALL
SELECT 'bad_poll_timeout', p_brand || '/' || p_name, 'soon' FROM s WHERE p_size > 40 AND p_size % 4 = 1
UNION ALL
SELECT 'missing_poll_interval', p_brand || '/' || p_name, NULL FROM s WHERE p_size = 40
UNION ALL
SELECT 'template_braces', p_brand || '/' || p_name, 'unexpected closing braces' FROM s WHERE p_size % 10 = 0
UNION ALL
SELECT 'blank_output_param', p_brand || '/' || p_name, NULL FROM s WHERE p_partkey % 13 = 0
UNION ALL
SELECT 'blank_output_field', p_brand || '/' || p_name, NULL FROM s WHERE p_partkey % 17 = 0
UNION ALL
SELECT 'unknown_rollback', p_brand || '/' || p_name, rb FROM s WHERE rb NOT IN ('economy', 'standard')
""")
def runbook_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runbook step rules over parts as steps (runbook =
    brand, step = name, function = type): duplicates, workers, offsets that
    cannot be published, poll settings (a timeout below the interval is
    allowed), template braces, output parameters, unknown rollbacks."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    steps = p.select(
        "p_brand", "p_name", "p_type",
        F.when(key % 11 == 0, F.lit(" ")).when(key % 11 != 1, F.lit("worker-1")).alias("worker"),
        F.concat(F.lit("T-"), (size - 25).cast("string"), F.lit("d")).alias("offset"),
        F.when(size > 40, F.concat(size.cast("string"), F.lit("m"))).alias("poll_interval"),
        F.when((size > 40) & (size % 4 == 1), F.lit("soon")).when((size >= 40) & ((size % 4 != 0) | (size == 40)), F.lit("5m"))
        .alias("poll_timeout"),
        F.when(size % 10 == 0, F.lit("{{a}} }}")).otherwise(F.lit("{{a}}")).alias("tmpl"),
        F.lower("p_type").alias("rollback"),
        F.create_map(F.when(key % 13 == 0, "").otherwise("ring"), F.when(key % 17 == 0, " ").otherwise("value")).alias("outputs"))
    known = steps.select("rollback").filter(F.col("rollback").isin("economy", "standard"))
    return Q.step_rules(steps, "p_brand", "p_name", "p_type", worker="worker", offset="offset",
                        poll_interval="poll_interval", poll_timeout="poll_timeout", params_template="tmpl",
                        rollback="rollback", known_rollbacks=known, output_params="outputs")


@register("phase_rules", sql="""
WITH p AS (SELECT o_custkey AS runbook, 'Phase ' || CAST(o_orderkey % 5 AS VARCHAR) AS phase,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'soon'
                  ELSE 'T-' || CAST(o_orderkey % 7 AS VARCHAR) || 'd' END AS off,
             o_orderkey % 3 AS n_steps FROM orders)
SELECT 'missing_offset' AS rule, CAST(runbook AS VARCHAR) || '/' || phase AS item, CAST(NULL AS VARCHAR) AS detail FROM p WHERE off IS NULL
UNION ALL SELECT 'bad_offset', CAST(runbook AS VARCHAR) || '/' || phase, off FROM p WHERE off = 'soon'
UNION ALL SELECT 'no_steps', CAST(runbook AS VARCHAR) || '/' || phase, NULL FROM p WHERE n_steps = 0
UNION ALL SELECT 'no_phases', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey NOT IN (SELECT runbook FROM p)
UNION ALL SELECT 'duplicate_phase', CAST(runbook AS VARCHAR) || '/' || lower(phase), CAST(count(*) AS VARCHAR)
          FROM p GROUP BY runbook, lower(phase) HAVING count(*) > 1
""")
def phase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: phase rules over orders as phases of their customer's runbook."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    phases = o.select(
        F.col("o_custkey").alias("runbook"), F.concat(F.lit("Phase "), (k % 5).cast("string")).alias("phase"),
        F.when(k % 7 == 1, "soon").when(k % 7 != 0, F.concat(F.lit("T-"), (k % 7).cast("string"), F.lit("d"))).alias("offset"),
        (k % 3).alias("n_steps"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("runbook"))
    return Q.phase_rules(books, phases, "runbook", "phase", "offset", "n_steps")


@register("version_listing", sql="""
SELECT p_brand AS runbook, p_size * 100000 + p_partkey AS version,
       row_number() OVER (ORDER BY p_brand, p_size * 100000 + p_partkey DESC) AS position FROM part
""")
def version_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runbook versions, by name and newest first."""
    v = table(spark, sf_dir, "part").select(F.col("p_brand").alias("runbook"),
                                            (F.col("p_size") * 100000 + F.col("p_partkey")).alias("version"))
    return L.ordered_listing(v, ["runbook", F.col("version").desc()])


@register("job_config_rules", sql="""
WITH j AS (SELECT CASE WHEN s_suppkey % 17 = 0 THEN ' ' ELSE 'job' || s_suppkey END AS name, s_suppkey % 7 AS tier, s_suppkey % 4 AS m,
             CASE WHEN s_suppkey % 3 = 0 THEN 'R' || (s_nationkey % 7) END AS t, CASE WHEN s_suppkey % 5 = 0 THEN 'R' || (s_nationkey % 6) END AS x,
             'N' || (s_suppkey % 30) AS e, 'N' || (s_suppkey % 27) AS f FROM supplier)
SELECT 'missing_job_name' AS rule, name AS item, CAST(NULL AS VARCHAR) AS detail FROM j WHERE trim(name) = ''
UNION ALL SELECT 'bad_tier', name, CAST(tier AS VARCHAR) FROM j WHERE tier NOT BETWEEN 1 AND 5
UNION ALL SELECT 'unknown_tenant_mode', name, 'some' FROM j WHERE m = 3
UNION ALL SELECT 'tenant_list_required', name, 'tenant_keys' FROM j WHERE m = 1 AND t IS NULL
UNION ALL SELECT 'tenant_list_required', name, 'exclude_keys' FROM j WHERE m = 2 AND x IS NULL
UNION ALL SELECT 'unknown_entity', name, 'include_entities:' || e FROM j WHERE CAST(substr(e, 2) AS INTEGER) > 24
UNION ALL SELECT 'unknown_entity', name, 'exclude_entities:' || f FROM j WHERE CAST(substr(f, 2) AS INTEGER) > 24
UNION ALL SELECT 'unknown_tenant', name, 'tenant_keys:' || t FROM j WHERE CAST(substr(t, 2) AS INTEGER) > 4
UNION ALL SELECT 'unknown_tenant', name, 'exclude_keys:' || x FROM j WHERE CAST(substr(x, 2) AS INTEGER) > 4
""")
def job_config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rules over suppliers as jobs, nations as entities and
    regions as tenants."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")

    def one(prefix: str, value: Column) -> Column:
        return F.array(F.concat(F.lit(prefix), value.cast("string")))

    jobs = table(spark, sf_dir, "supplier").select(
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("job"), k.cast("string"))).alias("name"),
        F.array((k % 7).cast("int")).alias("include_tiers"),
        F.when(k % 4 == 0, "all").when(k % 4 == 1, "specific").when(k % 4 == 2, "all_except").otherwise("some").alias("tenant_mode"),
        F.when(k % 3 == 0, one("R", n % 7)).alias("tenant_keys"), F.when(k % 5 == 0, one("R", n % 6)).alias("exclude_keys"),
        one("N", k % 30).alias("include_entities"), one("N", k % 27).alias("exclude_entities"))
    entities = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"))
    tenants = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("tenant_key"))
    return Q.job_rules(jobs, entities, tenants)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register("attr_match", sql=f"""
SELECT o.o_orderkey, o.o_custkey,
       list_extract({list(SEGMENTS)}, CAST(left(o.o_orderpriority, 1) AS INTEGER)) AS c_mktsegment,
       COALESCE(c.c_mktsegment = list_extract({list(SEGMENTS)}, CAST(left(o.o_orderpriority, 1) AS INTEGER)),
                false) AS matches
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def attr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: the segment each order expects (by priority) vs the customer's."""
    o = table(spark, sf_dir, "orders")
    seg = F.array(*[F.lit(s) for s in SEGMENTS])[F.substring("o_orderpriority", 1, 1).cast("int") - 1]
    exp = o.select("o_orderkey", "o_custkey", seg.alias("c_mktsegment"))
    cur = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return Q.attribute_mismatches(exp, cur, "o_custkey", "c_mktsegment")


@register("membership_verify", sql=f"""
WITH p AS (SELECT c_custkey AS member, list_extract({list(PRIORITIES)},
                  list_position({list(SEGMENTS)}, c_mktsegment)) AS grp FROM customer),
     m AS (SELECT DISTINCT o_orderpriority AS grp, o_custkey AS member FROM orders)
SELECT p.grp, p.member, m.member IS NOT NULL AS is_member
FROM p LEFT JOIN m ON p.grp = m.grp AND p.member = m.member
""")
def membership_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each customer in the group (priority) its segment maps to?"""
    seg_to_pr = F.create_map(*[x for s, p in zip(SEGMENTS, PRIORITIES) for x in (F.lit(s), F.lit(p))])
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"),
                                                    seg_to_pr[F.col("c_mktsegment")].alias("grp"))
    mem = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("member"))
    return Q.verify_membership(pairs, mem, ["grp", "member"])


@register("settings_upsert", sql="""
WITH base AS (SELECT s_suppkey AS setting_key, s_acctbal AS value FROM supplier),
     chg AS (SELECT s_suppkey AS setting_key, round(s_acctbal + 1000, 2) AS value FROM supplier WHERE s_acctbal < 1000
             UNION ALL SELECT p_partkey + 1000000, p_retailprice FROM part)
SELECT COALESCE(chg.setting_key, base.setting_key) AS setting_key, COALESCE(chg.value, base.value) AS value
FROM base FULL OUTER JOIN chg ON base.setting_key = chg.setting_key
""")
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings MERGE — changed keys updated, new keys inserted."""
    s = table(spark, sf_dir, "supplier")
    base = s.select(F.col("s_suppkey").alias("setting_key"), F.col("s_acctbal").alias("value"), F.lit(0).alias("v"))
    chg = (s.filter(F.col("s_acctbal") < 1000)
           .select(F.col("s_suppkey").alias("setting_key"), F.round(F.col("s_acctbal") + 1000, 2).alias("value"),
                   F.lit(1).alias("v"))
           .unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("setting_key"),
                                                             F.col("p_retailprice").alias("value"), F.lit(1).alias("v"))))
    return merge_latest(base, chg, ["setting_key"], ["v"]).select("setting_key", "value")
