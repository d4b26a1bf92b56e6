"""Results of a job kept in the shared folder, and small bounded helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inventa.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: cuts the
    lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
