"""Runbook data sources (S15-S17): a query against a SQL database, a
Dataverse TDS endpoint, or the Spark catalog, returned as an all-string
table.

``sql`` and ``dataverse`` go through Spark's JDBC reader (the query is
pushed to the database; ``queryTimeout`` 120 s); ``databricks`` — the
warehouse itself — is ``spark.sql``.  Connection details come from the
caller; nothing is read from the environment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SOURCE_TYPES = ("sql", "dataverse", "databricks")
QUERY_TIMEOUT_SECONDS = 120


def as_strings(df: DataFrame) -> DataFrame:
    """Every column cast to string; NULL stays NULL."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def query_columns(spark: SparkSession, query: str) -> list[str]:
    """U8: the select-list columns of a query, from Spark's analyzer (no
    text parsing, nothing executed)."""
    return spark.sql(query).columns


def ensure_databases(spark: SparkSession, names: tuple[str, ...] = ("bronze", "silver")) -> None:
    """The catalog schemas."""
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}")


def run_query(spark: SparkSession, source_type: str, query: str, jdbc_url: str | None = None,
              jdbc_properties: dict[str, str] | None = None, num_partitions: int | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None) -> DataFrame:
    """Dispatch on the source type; unknown types and blank
    queries raise.  A partition column splits a large JDBC read into
    parallel range queries."""
    if not source_type or not source_type.strip():
        raise ValueError("data source type is required")
    kind = source_type.strip().lower()
    if kind not in SOURCE_TYPES:
        raise ValueError(f"unknown data source type: {source_type}")
    if not query or not query.strip():
        raise ValueError("data source query is required")
    if kind == "databricks":
        return as_strings(spark.sql(query))
    if not jdbc_url:
        raise ValueError(f"{kind} source needs a connection url")
    reader = (spark.read.format("jdbc").option("url", jdbc_url)
              .option("queryTimeout", QUERY_TIMEOUT_SECONDS))
    for k, v in (jdbc_properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions or 8))
    else:
        reader = reader.option("query", query)
    return as_strings(reader.load())
