"""Queries exercising the column functions (offsets, templates, multi-valued
cells, error classes, URL and size parsing, flags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.functions import durations as D
from inventa.functions import errors as ER
from inventa.functions import jsonmap as J
from inventa.functions import templates as TP
from inventa.functions import text as TX
from inventa.plans.registry import register
from inventa.session import table

TS_FMT = "yyyy-MM-dd HH:mm:ss"

# The runbook used by the phase queries: (phase name, offset).  Its last
# offset is invalid on purpose (fractions are rejected).
RUNBOOK_PHASES = (("prep", "T-5d"), ("notify", "T-90s"), ("cutover", "T-0"), ("bad", "T-1.5d"))

OFFSET_SQL = """CASE WHEN {o} = 'T-0' THEN 0
     WHEN regexp_full_match({o}, 'T-[0-9]+[dhms]') THEN
       CASE right({o}, 1)
         WHEN 'd' THEN CAST(substr({o}, 3, length({o}) - 3) AS INTEGER) * 1440
         WHEN 'h' THEN CAST(substr({o}, 3, length({o}) - 3) AS INTEGER) * 60
         WHEN 'm' THEN CAST(substr({o}, 3, length({o}) - 3) AS INTEGER)
         ELSE CAST(ceil(CAST(substr({o}, 3, length({o}) - 3) AS INTEGER) / 60.0) AS INTEGER) END
END"""

PHASES_VALUES = ", ".join(f"('{n}', '{o}', {i})" for i, (n, o) in enumerate(RUNBOOK_PHASES))


def runbook_phases_col():
    """The runbook's phases as a literal array.  Offsets are parsed on the
    literals, so Catalyst folds them to constants once instead of running
    the regexes for every exploded row."""
    return F.array(*[F.struct(F.lit(n).alias("phase_name"), F.lit(o).alias("offset"), F.lit(i).alias("phase_index"),
                              D.offset_minutes(F.lit(o)).alias("offset_minutes"),
                              D.offset_error(F.lit(o)).alias("offset_error"))
                     for i, (n, o) in enumerate(RUNBOOK_PHASES)])


@register("phase_plan", sql=f"""
SELECT o.o_orderkey AS batch_id, p.phase_name, p.phase_index,
       {OFFSET_SQL.format(o='p.off')} AS offset_minutes,
       strftime(o.o_orderdate - to_minutes(CAST({OFFSET_SQL.format(o='p.off')} AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS due_at,
       CASE WHEN ({OFFSET_SQL.format(o='p.off')}) IS NULL THEN 'Invalid offset number: ' || p.off END AS offset_error
FROM orders o, (VALUES {PHASES_VALUES}) p(phase_name, off, phase_index)
""")
def phase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch (order, start = order date) × the runbook's
    phases: offset in minutes, due time, offset error."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = o.select("o_orderkey", "o_orderdate", F.explode(runbook_phases_col()).alias("p"))
    mins = F.col("p.offset_minutes")
    return p.select(
        F.col("o_orderkey").alias("batch_id"), F.col("p.phase_name").alias("phase_name"),
        F.col("p.phase_index").alias("phase_index"), mins.alias("offset_minutes"),
        F.date_format(D.due_at("o_orderdate", mins), TS_FMT).alias("due_at"),
        F.col("p.offset_error").alias("offset_error"))


@register("offset_rules", sql="""
WITH t AS (
  SELECT DISTINCT o_orderpriority AS pr FROM orders
), o AS (
  SELECT pr, 'T-' || CAST(CAST(left(pr, 1) AS INTEGER) * 15 AS VARCHAR) || 's' AS off1,
         'T-' || left(pr, 1) || lower(substr(pr, 3, 1)) AS off2 FROM t
)
SELECT pr AS priority, off1, off2,
  """ + OFFSET_SQL.format(o="off1") + """ AS minutes1,
  """ + OFFSET_SQL.format(o="off2") + """ AS minutes2,
  (off2 = 'T-0' OR TRY_CAST(regexp_extract(off2, '^T-([0-9]+)[dhms]$', 1) AS INTEGER) > 0) IS TRUE AS publishable2
FROM o
""")
def offset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offsets derived from each order priority (seconds round up;
    unknown suffixes rejected; publishability)."""
    pr = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    off1 = F.concat(F.lit("T-"), (F.substring("priority", 1, 1).cast("int") * 15).cast("string"), F.lit("s"))
    off2 = F.concat(F.lit("T-"), F.substring("priority", 1, 1), F.lower(F.substring("priority", 3, 1)))
    return pr.select("priority", off1.alias("off1"), off2.alias("off2"),
                     D.offset_minutes(off1).alias("minutes1"), D.offset_minutes(off2).alias("minutes2"),
                     D.offset_publishable(off2).alias("publishable2"))


@register("template_expand", sql="""
SELECT c_custkey,
  replace(replace(replace(replace(
     'Dear {{c_name}} ({{c_mktsegment}}), batch {{_batch_id}} ref {{nation}} {{missing}}',
     '{{c_name}}', c_name), '{{c_mktsegment}}', c_mktsegment),
     '{{_batch_id}}', CAST(c_nationkey AS VARCHAR)), '{{nation}}', CAST(c_nationkey AS VARCHAR)) AS text,
  'missing' AS unresolved,
  '{"c_custkey":"' || CAST(c_custkey AS VARCHAR) || '","c_name":"' || c_name || '","c_acctbal":"'
     || CAST(c_acctbal AS VARCHAR) || '","c_mktsegment":"' || c_mktsegment || '","_nation":"'
     || CAST(c_nationkey AS VARCHAR) || '"}' AS data_json
FROM customer
""")
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member map from the customer row; ``{{nation}}`` resolves via
    the ``_nation`` fallback; ``{{missing}}`` stays and is reported."""
    c = table(spark, sf_dir, "customer").withColumn("_nation", F.col("c_nationkey").cast("string"))
    data = J.row_to_string_map(["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "_nation"])
    tmpl = F.lit("Dear {{c_name}} ({{c_mktsegment}}), batch {{_batch_id}} ref {{nation}} {{missing}}")
    e = TP.expand(tmpl, data, batch_id=F.col("c_nationkey"))
    return c.select("c_custkey", e.text.alias("text"),
                    F.array_join(e.unresolved, ",").alias("unresolved"),
                    F.to_json(data).alias("data_json"))


@register("worker_merge", sql="""
WITH w AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st,
                  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr
           FROM orders GROUP BY 1)
SELECT c.c_custkey,
       COALESCE(w.pr, c.c_mktsegment) AS segment_or_priority,
       COALESCE(w.st, 'none') AS status,
       c.c_name AS name,
       CASE WHEN w.o_custkey IS NULL THEN 0 ELSE 2 END AS n_worker_keys
FROM customer c LEFT JOIN w ON c.c_custkey = w.o_custkey
""")
def worker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member data (customer row) overlaid with the worker output of
    its latest order (worker wins on a shared key); malformed worker JSON
    would count as an empty map."""
    c = table(spark, sf_dir, "customer")
    latest = (table(spark, sf_dir, "orders").groupBy("o_custkey")
              .agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
                   .alias("o")))
    worker_json = F.to_json(F.create_map(F.lit("segment"), F.col("o.o_orderpriority"),
                                         F.lit("status"), F.col("o.o_orderstatus")))
    x = c.join(latest, c.c_custkey == latest.o_custkey, "left")
    member = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("status"), F.lit("none"),
                          F.lit("name"), F.col("c_name"))
    worker = F.when(F.col("o_custkey").isNotNull(), J.parse_string_map(worker_json)).otherwise(
        J.parse_string_map(F.lit("not json")))
    merged = J.merge_worker_data(member, worker)
    return x.select("c_custkey", merged["segment"].alias("segment_or_priority"), merged["status"].alias("status"),
                    merged["name"].alias("name"), F.size(worker).alias("n_worker_keys"))


@register("template_params", sql="""
SELECT o_orderkey,
  'mbx-' || CAST(o_custkey AS VARCHAR) AS p_mailbox,
  o_orderstatus || '/' || o_orderpriority AS p_route,
  CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'brace' END AS brace_check
FROM orders
""")
def template_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter map expanded per order; brace balance of the
    template chosen by status."""
    o = table(spark, sf_dir, "orders")
    values = F.create_map(F.lit("cust"), F.col("o_custkey").cast("string"),
                          F.lit("status"), F.col("o_orderstatus"), F.lit("_priority"), F.col("o_orderpriority"))
    params = F.create_map(F.lit("mailbox"), F.lit("mbx-{{cust}}"), F.lit("route"), F.lit("{{status}}/{{priority}}"))
    e = TP.expand_params(params, values)
    tmpl = F.when(F.col("o_orderstatus") == "F", F.lit("{{a}} and {{b}}")).otherwise(F.lit("{{a}} }}{{"))
    return o.select("o_orderkey", e.params["mailbox"].alias("p_mailbox"), e.params["route"].alias("p_route"),
                    F.when(TP.brace_balance_error(tmpl).isNull(), F.lit("ok")).otherwise(F.lit("brace")).alias("brace_check"))


@register("multi_value", sql=r"""
WITH p AS (
  SELECT doc_id, lang,
         list_filter(string_split(text, CASE WHEN lang = 'fr' THEN ';' ELSE ',' END), lambda x: x <> '') AS parts
  FROM documents
)
SELECT doc_id,
       CAST(len(parts) AS INTEGER) AS n_parts,
       CAST(list_sum(list_transform(parts, lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))))) AS BIGINT) AS part_chars
FROM p
""")
def multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole document texts as multi-valued cells (comma, or semicolon
    for French): parts, trimmed, empties removed."""
    d = table(spark, sf_dir, "documents")
    fmt = F.when(F.col("lang") == "fr", F.lit(J.SEMICOLON)).otherwise(F.lit(J.COMMA))
    parts = J.multi_value_array(F.col("text"), fmt)
    from inventa.functions.numeric import size_or_null
    return d.select("doc_id", size_or_null(parts).alias("n_parts"),
                    F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("part_chars"))


ER_FAMILY_SQL = "CASE lang WHEN 'en' THEN 'graph' WHEN 'fr' THEN 'exo' WHEN 'de' THEN 'spo' ELSE 'mde' END"
ER_CODE_SQL = ("CASE source WHEN 'src0' THEN 401 WHEN 'src1' THEN 429 WHEN 'src2' THEN 403 "
               "WHEN 'src3' THEN 404 WHEN 'src4' THEN 503 END")


def _sql_rx(p: str) -> str:
    return p.replace("'", "''")


@register("error_class", sql=f"""
WITH d AS (SELECT doc_id, text, {ER_FAMILY_SQL} AS fam, {ER_CODE_SQL} AS code FROM documents)
SELECT doc_id, fam AS api_family,
  CASE WHEN code = 401 THEN 'Auth'
       WHEN code IN (429, 503) THEN 'Throttle'
       WHEN code = 404 THEN 'Skippable'
       WHEN code = 403 THEN CASE WHEN fam IN ('spo', 'mde') THEN 'Skippable' ELSE 'Auth' END
       WHEN regexp_matches(text, '(?i)({_sql_rx(ER.AUTH_PATTERN)})') THEN 'Auth'
       WHEN regexp_matches(text, '(?i)({_sql_rx(ER.THROTTLE_PATTERN)})')
            OR (fam = 'exo' AND regexp_matches(text, '(?i)({_sql_rx(ER.THROTTLE_PATTERN_EXO_EXTRA)})')) THEN 'Throttle'
       WHEN (fam = 'graph' AND regexp_matches(text, '(?i)({_sql_rx(ER.SKIPPABLE_PATTERNS["graph"])})'))
         OR (fam = 'exo' AND regexp_matches(text, '(?i)({_sql_rx(ER.SKIPPABLE_PATTERNS["exo"])})'))
         OR (fam = 'spo' AND regexp_matches(text, '(?i)({_sql_rx(ER.SKIPPABLE_PATTERNS["spo"])})'))
         OR (fam = 'mde' AND regexp_matches(text, '(?i)({_sql_rx(ER.SKIPPABLE_PATTERNS["mde"])})')) THEN 'Skippable'
       ELSE 'Unknown' END AS category,
  TRY_CAST(NULLIF(regexp_extract(text, '(?i)Retry-After[:\\s]+(\\d+)', 1), '') AS INTEGER) AS retry_after,
  round(least(2.0 * pow(2.0, CAST(doc_id % 6 AS DOUBLE)), 120.0), 1) AS delay_seconds
FROM d
""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify each document text as a collector error message
    (API family from the language, status code from the source)."""
    d = table(spark, sf_dir, "documents")
    fam = (F.when(F.col("lang") == "en", "graph").when(F.col("lang") == "fr", "exo")
            .when(F.col("lang") == "de", "spo").otherwise("mde"))
    code = (F.when(F.col("source") == "src0", 401).when(F.col("source") == "src1", 429)
             .when(F.col("source") == "src2", 403).when(F.col("source") == "src3", 404)
             .when(F.col("source") == "src4", 503))
    attempt = F.pmod(F.col("doc_id"), F.lit(6)) + 1
    return d.select("doc_id", fam.alias("api_family"),
                    ER.classify_error(code, F.col("text"), fam).alias("category"),
                    ER.retry_after_seconds("text").alias("retry_after"),
                    D.backoff_seconds(attempt).alias("delay_seconds"))


@register("url_parts", sql="""
SELECT page_id,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '[^a-z0-9_]', '_', 'g') AS table_name,
  regexp_matches(url, '(?i)-my\\.sharepoint\\.com/personal/') AS is_personal,
  regexp_matches(html, '(?i)spo-grid-all-users') AS is_eeeu,
  regexp_matches(html, '(?i)#ext#|urn:spo:guest') AS is_guest,
  CASE WHEN regexp_matches(url, '^https') THEN 'GROUP#0' ELSE 'STS#3' END AS template_key,
  regexp_matches(url, '^https') AS is_modern
FROM pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL host and path, derived table name, personal-site,
    EEEU and guest flags over whole pages, template key and modern flag."""
    p = table(spark, sf_dir, "pages")
    tkey = TX.template_key(F.when(F.col("url").startswith("https"), "GROUP").otherwise("STS"),
                           F.when(F.col("url").startswith("https"), "0").otherwise("3"))
    return p.select("page_id", TX.url_host("url").alias("host"), TX.url_path("url").alias("path"),
                    TX.sanitize_name(TX.url_host("url")).alias("table_name"),
                    TX.is_personal_site("url").alias("is_personal"), TX.is_eeeu("html").alias("is_eeeu"),
                    TX.is_guest("html").alias("is_guest"), tkey.alias("template_key"),
                    TX.is_modern_template(tkey).alias("is_modern"))


@register("size_text", sql="""
WITH t AS (
  SELECT p_partkey, p_name || ' ' || CAST(p_size AS VARCHAR) || ' MB (' ||
         format('{:,}', CAST(p_size AS BIGINT) * 1048576 + p_partkey) || ' bytes)' AS size_text,
         CASE WHEN p_size % 2 = 0 THEN '00000000-0000-0000-0000-000000000000' ELSE p_brand END AS group_id
  FROM part
)
SELECT p_partkey,
  CAST(replace(regexp_extract(size_text, '\\(([0-9,]+) bytes\\)', 1), ',', '') AS BIGINT) AS size_bytes,
  round(CAST(replace(regexp_extract(size_text, '\\(([0-9,]+) bytes\\)', 1), ',', '') AS DOUBLE) / 1048576.0, 2) AS size_mb,
  CASE WHEN group_id = '00000000-0000-0000-0000-000000000000' THEN NULL ELSE group_id END AS group_id,
  group_id <> '00000000-0000-0000-0000-000000000000' AS is_group_connected
FROM t
""")
def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human size text → bytes and MB; all-zero GUID → NULL."""
    p = table(spark, sf_dir, "part")
    txt = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" MB ("),
                   F.format_number(F.col("p_size").cast("bigint") * 1048576 + F.col("p_partkey"), 0), F.lit(" bytes)"))
    gid = F.when(F.col("p_size") % 2 == 0, F.lit(TX.EMPTY_GUID)).otherwise(F.col("p_brand"))
    g = TX.empty_guid_to_null(gid)
    return p.select("p_partkey", TX.size_text_bytes(txt).alias("size_bytes"), TX.size_text_mb(txt).alias("size_mb"),
                    g.alias("group_id"), g.isNotNull().alias("is_group_connected"))


@register("name_hint", sql="""
WITH n AS (
  SELECT event_id, event_type || CASE WHEN value > 10 THEN '_id' WHEN value > 5 THEN 'Date'
                                      WHEN value > 2 THEN 'Email' ELSE 'Id' END AS column_name FROM events
)
SELECT event_id, column_name,
  CASE WHEN contains(lower(column_name), 'time') OR contains(lower(column_name), 'date') THEN '2024-02-08T00:00:00Z'
       WHEN contains(lower(column_name), 'email') THEN 'user@example.com'
       WHEN ends_with(lower(column_name), '_id') OR ends_with(column_name, 'Id') THEN 'sample_id_001'
       ELSE 'sample_value' END AS sample
FROM n
""")
def name_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-template sample value from a column-name hint (as_of fixed)."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.col("event_type"), F.when(F.col("value") > 10, "_id").when(F.col("value") > 5, "Date")
                    .when(F.col("value") > 2, "Email").otherwise("Id"))
    return e.select("event_id", name.alias("column_name"),
                    TX.sample_value_for(name, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("sample"))


@register("output_params", sql="""
WITH r AS (
  SELECT event_id, event_type, props,
         CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS status,
         CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN '{"complete": "false", "k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}'
              WHEN event_type = 'view' THEN '{"Complete": false, "K": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}'
              WHEN event_type = 'click' THEN '{"data": {"k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}'
              ELSE props END AS result
  FROM events
)
SELECT event_id,
  CASE WHEN event_type = 'click' THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS k_value,
  (status = 'Success' AND event_type = 'view' AND event_id % 5 <> 0) AS still_polling,
  CASE WHEN event_type = 'click' THEN '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' ELSE result END AS final_result
FROM r
""")
def output_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker results built from events.props: case-insensitive
    output field ``k``, still-polling test, final result (``data`` or whole)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    result = (F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0),
                     F.concat(F.lit('{"complete": "false", "k": '), k, F.lit("}")))
               .when(F.col("event_type") == "view", F.concat(F.lit('{"Complete": false, "K": '), k, F.lit("}")))
               .when(F.col("event_type") == "click", F.concat(F.lit('{"data": {"k": '), k, F.lit("}}")))
               .otherwise(F.col("props")))
    status = F.when(F.col("event_type") == "error", "Failure").otherwise("Success")
    return e.select("event_id", J.json_field_ci(result, "k").alias("k_value"),
                    J.still_polling(status, result).alias("still_polling"),
                    J.final_result(result).alias("final_result"))
