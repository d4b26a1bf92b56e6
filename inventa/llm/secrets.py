r"""Secret scan with multipart credential linking.

Base spans come from three patterns (assignments, access identifiers, long hex
runs).  Two weaker candidates mean little alone: a mixed 40-character key
(``key``) and an address (``endpoint``).  An interval join of the parts of a
text links them: a key counts only where an access identifier lies within
``REACH`` code points, an endpoint only where an identifier and a secret (an
assignment or a linked key) both do.  The join's keys are the text and a bin of
``REACH`` positions, every bin that a candidate touches and one more on each
side of its complements, so no text's or bin's candidates are paired beyond
their neighbours, and only texts that hold complementary parts take part.

All work is DataFrame operations.  Positions are code points, ends exclusive.

Defined cases: null and empty texts have no spans; equal rows have equal
answers, and each row of the input gives one row; a null doc_id is an id of its
own; an empty table gives no rows; other columns are ignored by :func:`scan`
and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm.fingerprint import let
from inventa.llm.registry import register
from inventa.llm.storage import stored
from inventa.session import table

REACH = 400
STEP = 256
# The base patterns of the scan.  The class runs are greedy and
# maximal, so the least length may stand in the access and hex patterns; an
# assignment of a short value must still consume its text.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: weak candidates
KEY = r"(?<![A-Za-z0-9/+])(?=[A-Za-z0-9/+]*[a-z])(?=[A-Za-z0-9/+]*[A-Z])(?=[A-Za-z0-9/+]*[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])"
ENDPOINT = r"""https?://[^\s"'<>|]+"""
KINDS = ("assign", "access", "hex", "key", "endpoint")


def running_starts(sizes: Column) -> Column:
    """Exclusive running sums of an array of longs, in blocks of ``STEP`` so
    that the copies made by appending stay small for long arrays."""
    def appended(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        return F.aggregate(values, zero, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]

    def blocked(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")),
                             lambda b: F.slice(a, b * STEP + 1, STEP))
        return let(blocks, lambda bs: F.flatten(F.zip_with(
            bs, appended(F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + x))),
            lambda b, base: F.transform(appended(b), lambda s: s + base))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(let(sizes, blocked))


def spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """The matches of a pattern, leftmost and not overlapping, as (start, kind
    number, end, kind).  ``least`` drops matches whose group 1 is shorter."""
    def length(x: Column) -> Column:
        return F.char_length(x).cast("long")

    def located(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return let(running_starts(F.zip_with(gaps, hits, lambda g, h: length(g) + length(h))), lambda starts: F.zip_with(
            F.zip_with(starts, gaps, lambda s, g: s + length(g)), hits, lambda s, h: F.struct(
                s.alias("start"), F.lit(KINDS.index(kind)).alias("no"), (s + length(h)).alias("end"), F.lit(kind).alias("kind"))))

    none = F.array().cast("array<struct<start:bigint, no:int, end:bigint, kind:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    if least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        found = F.filter(F.zip_with(found, values, lambda s, v: F.when(F.char_length(v) >= least, s)), lambda s: s.isNotNull())
    return F.coalesce(F.when(text.rlike(pattern), found), none)


def _parts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64(text, F.lit(7)).alias("text_hash"),
        spans(text, ASSIGN, "assign", ASSIGN_LENGTH).alias("assign"), spans(text, ACCESS, "access").alias("access"),
        spans(text, HEX, "hex").alias("hex"), spans(text, KEY, "key").alias("key"),
        spans(text, ENDPOINT, "endpoint").alias("endpoint"))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_hash, linked): the weak candidates that have complements."""
    both = parts.where((F.size("access") > 0) & (F.size("key") + F.size("endpoint") > 0)).distinct()

    def rows(name: str) -> DataFrame:
        return both.select("doc_id", "text_hash", F.explode(name).alias("s"))

    def binned(rows: DataFrame, wider: int) -> DataFrame:
        # a span may meet another at its end itself, so that bin counts too
        bins = F.sequence(F.floor(F.col("s.start") / reach) - wider, F.floor(F.col("s.end") / reach) + wider)
        return rows.select("doc_id", "text_hash", F.explode(bins).alias("bin"), "s")

    def near(weak: DataFrame, strong: DataFrame) -> DataFrame:
        a, b = binned(weak, 0).alias("a"), binned(strong, 1).alias("b")
        on = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
              & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.s.start") <= F.col("b.s.end") + reach)
              & (F.col("b.s.start") <= F.col("a.s.end") + reach))
        return a.join(b, on, "left_semi").select("doc_id", "text_hash", "s").distinct()

    access = rows("access")
    keys = near(rows("key"), access)
    ends = near(near(rows("endpoint"), access), rows("assign").unionByName(keys))
    return (keys.unionByName(ends).groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("linked")))


def _with_linked(rows: DataFrame, linked: DataFrame) -> DataFrame:
    other = linked.withColumnRenamed("doc_id", "linked_id").withColumnRenamed("text_hash", "linked_hash")
    on = F.col("doc_id").eqNullSafe(F.col("linked_id")) & (F.col("text_hash") == F.col("linked_hash"))
    return rows.join(other, on, "left").drop("linked_id", "linked_hash")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, ``base`` and ``spans`` (arrays
    of start, no, end, kind in the order of start and kind)."""
    parts = stored(_parts(docs), "secrets")
    rows = parts.select("doc_id", "text_hash", "assign", "access", "hex",
                        F.sort_array(F.concat("assign", "access", "hex")).alias("base"))
    extra = F.coalesce("linked", F.array().cast("array<struct<start:bigint, no:int, end:bigint, kind:string>>"))
    return _with_linked(rows, _linked(parts, reach)).select(
        "doc_id", "text_hash", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), "base", F.sort_array(F.concat("base", extra)).alias("spans"))


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows with every span of ``text`` replaced by ``<kind>`` (overlapping
    spans by one mark, of the first's kind); all else is kept."""
    found = scan(docs, reach).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").distinct()
    other = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = (F.col("row.doc_id").eqNullSafe(F.col("found_id"))
          & (F.xxhash64(F.coalesce("row.text", F.lit("")), F.lit(7)) == F.col("found_hash")))
    joined = F.expr("""aggregate(spans, CAST(array() AS array<struct<start:bigint, no:int, end:bigint, kind:string>>),
        (acc, s) -> IF(size(acc) > 0 AND s.start < element_at(acc, -1).end,
          concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'no', element_at(acc, -1).no,
            'end', greatest(element_at(acc, -1).end, s.end), 'kind', element_at(acc, -1).kind))),
          concat(acc, array(s))))""")
    text = F.expr("""concat(array_join(zip_with(m, concat(array(0L), transform(m, s -> s.end)),
        (s, b) -> IF(s IS NULL, '', concat(substring(row.text, int(b) + 1, int(s.start - b)), '<', s.kind, '>'))), ''),
        substring(row.text, int(element_at(m, -1).end) + 1))""")
    marked = rows.join(other, on, "left").withColumn("m", F.when(F.col("spans").isNotNull(), joined))
    clean = F.when(F.col("m").isNull(), F.col("row.text")).otherwise(text)
    return marked.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def span_list(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op9_credential_links")
def op9_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of every whole document."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_list("base"), 256).alias("base_sha256"),
        span_list("spans").alias("spans"))
