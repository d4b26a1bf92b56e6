"""CSV member intake.

Spark's CSV reader does the parsing (quotes, doubled quotes, trimmed cells,
CRLF, blank lines skipped, short rows padded); validation is a violations
DataFrame.  Files are read whole (``multiLine``), so a file is never split and
its row numbers come from ``monotonically_increasing_id`` minus the smallest id
seen for that file (an aggregate + join, no window over a file).  An upload of
more than 10 MB is rejected before its rows are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upload limits.
MAX_CSV_BYTES = 10 * 1024 * 1024
MAX_ROWS = 50_000
WHITESPACE = " \t\r\n\x0b\x0c"

READ_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE", "inferSchema": "false",
}


def read_member_csv(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """All-string member rows plus ``_file`` and 1-based ``_row``
    (header = row 1); NULL cells (short rows) become "".  Files of more than
    ``max_bytes`` are left out by their listed size, unread."""
    raw = spark.read.options(**READ_OPTIONS).csv(path)
    if max_bytes is not None:
        raw = raw.where(F.col("_metadata.file_size") <= max_bytes)
    # every cell is trimmed after parsing, quoted ones included (partition
    # columns of a folder of uploads keep their inferred type)
    cells = [F.btrim(F.coalesce(F.col(f"`{f.name}`"), F.lit("")), F.lit(WHITESPACE)).alias(f.name)
             if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in raw.schema.fields]
    df = raw.select(*cells,
                    F.col("_metadata.file_path").alias("_file"),
                    F.monotonically_increasing_id().alias("_mid"))
    first = df.groupBy("_file").agg(F.min("_mid").alias("_first"))
    return (df.join(first, "_file")
            .withColumn("_row", (F.col("_mid") - F.col("_first") + 2).cast("long"))
            .drop("_mid", "_first"))


def header_errors(columns: Sequence[str], key_column: str, expected: Sequence[str]) -> list[tuple[str, str]]:
    """(code, column) for a missing key column / missing expected columns
    (errors) and unexpected columns (warnings), case-insensitive."""
    have = {c.lower() for c in columns}
    exp = {c.lower() for c in expected}
    out: list[tuple[str, str]] = []
    if key_column.lower() not in have:
        out.append(("missing_key_column", key_column))
        return out
    missing = [c for c in expected if c.lower() not in have]
    if missing:
        return out + [("missing_column", c) for c in missing]
    return out + [("unexpected_column", c) for c in columns if c.lower() not in exp and not c.startswith("_")]


def row_violations(rows: DataFrame, key_column: str) -> DataFrame:
    """V5: per file, rows with an empty key and rows repeating a key seen on
    an earlier row (case-insensitive; the first occurrence is kept)."""
    key = F.col(f"`{key_column}`")
    blank = F.trim(key) == ""
    empties = rows.filter(blank).select("_file", "_row", F.lit("empty_key").alias("code"), key.alias("key"))
    keyed = rows.filter(~blank).withColumn("_k", F.lower(key))
    first = keyed.groupBy("_file", "_k").agg(F.min("_row").alias("_first_row"))
    dups = (keyed.join(first, ["_file", "_k"]).filter(F.col("_row") > F.col("_first_row"))
            .select("_file", "_row", F.lit("duplicate_key").alias("code"), key.alias("key")))
    return empties.unionByName(dups)


def byte_violations(spark: SparkSession, path: str, max_bytes: int = MAX_CSV_BYTES) -> DataFrame:
    """V5: files over the byte limit (from the listing, contents unread)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return (files.filter(F.col("length") > max_bytes)
            .select(F.col("path").alias("_file"), F.lit(None).cast("long").alias("_row"), F.lit("too_many_bytes").alias("code"),
                    F.col("length").cast("string").alias("key")))


def accepted(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """V5: the rows of files without any violation (a file is taken whole or
    not at all)."""
    return rows.join(violations.select("_file").distinct(), "_file", "left_anti")


def size_violations(rows: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """V5: files over the row limit."""
    return (rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > max_rows)
            .select("_file", F.lit(None).cast("long").alias("_row"), F.lit("too_many_rows").alias("code"),
                    F.col("n").cast("string").alias("key")))


def header_violations(rows: DataFrame, columns: Sequence[str], key_column: str, expected: Sequence[str]) -> DataFrame:
    """U6 for every file of a folder: its missing columns (the files of a folder
    share one header)."""
    missing = [(code, c) for code, c in header_errors(columns, key_column, expected) if code != "unexpected_column"]
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(c).alias("key")) for code, c in missing]) if missing else \
        F.array().cast("array<struct<code:string,key:string>>")
    return (rows.select("_file").distinct().select("_file", F.lit(None).cast("long").alias("_row"), F.explode(each).alias("e"))
            .select("_file", "_row", "e.*"))


def intake(spark: SparkSession, path: str, key_column: str, expected: Sequence[str], max_bytes: int = MAX_CSV_BYTES,
           max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """V5: (accepted rows, violations) of the uploads of a folder.  Sizes are
    decided from the listing, before a file is parsed; any violation rejects the
    file as a whole; a file with a header alone is accepted with no rows."""
    rows = read_member_csv(spark, path, max_bytes)
    columns = [c for c in rows.columns if not c.startswith("_")]
    found = byte_violations(spark, path, max_bytes).unionByName(size_violations(rows, max_rows))
    found = found.unionByName(header_violations(rows, columns, key_column, expected))
    own = next((c for c in columns if c.lower() == key_column.lower()), None)
    if own is not None:
        found = found.unionByName(row_violations(rows, own))
    return accepted(rows, found), found


def template_row(spark: SparkSession, columns: Sequence[str], samples: Sequence[str]) -> DataFrame:
    """The CSV template — one sample row under the header."""
    return spark.createDataFrame([tuple(samples)], list(columns))


def write_template(df: DataFrame, path: str) -> None:
    """Header + quoted cells (doubled quotes) as one small CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").option("quote", '"') \
        .option("escape", '"').csv(path)
