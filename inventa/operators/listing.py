"""Ordering, paging, optional filters and global row indexes (O1-O6, P28,
P29, W8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventa.session import scratch_path

# Fixed values.
MAX_PAGE = 100
TERMINAL_BATCH_STATUSES = ("completed", "failed")

_LOW_BITS = (1 << 33) - 1


def page(df: DataFrame, order_by: Sequence[Column], offset: int = 0, limit: int = MAX_PAGE) -> DataFrame:
    """O1: ``ORDER BY … OFFSET o FETCH l`` with ``l`` capped at 100.  Spark
    plans it as a per-partition top-(o+l) followed by one merge."""
    limit = min(limit, MAX_PAGE)
    return df.orderBy(*order_by).offset(offset).limit(limit)


def top1(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """O2: ``TOP 1``."""
    return df.orderBy(*order_by).limit(1)


def apply_filters(df: DataFrame, **equals: object) -> DataFrame:
    """Optional filters — only the ones given (not None) are applied."""
    for col, value in equals.items():
        if value is not None:
            df = df.filter(F.col(col) == F.lit(value))
    return df


def active_only(df: DataFrame, status_col: str = "status") -> DataFrame:
    """``status NOT IN ('completed', 'failed')``."""
    return df.filter(~F.col(status_col).isin(*TERMINAL_BATCH_STATUSES))


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """A 0-based global index in ``order_by`` order without moving all
    rows into one partition.

    Rows are range-sorted and written once to the shared folder; each row's position inside its partition comes
    from ``monotonically_increasing_id`` (low 33 bits) and each partition's
    start from a running sum over the per-partition counts — a table with
    one row per partition, so its broadcast is bounded by the partition
    count.  The written rows keep their index when an executor is lost."""
    aside = scratch_path(df.sparkSession, "row_index")
    df.sort(*order_by).withColumn("_mid", F.monotonically_increasing_id()).write.parquet(aside)
    sorted_df = df.sparkSession.read.parquet(aside)
    pid = F.shiftright(F.col("_mid"), 33)
    counts = sorted_df.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_start", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_pid", F.coalesce("_start", F.lit(0)).alias("_start"))
    out = (sorted_df.withColumn("_pid", pid)
           .join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
           .drop("_pid", "_start", "_mid"))
    return out


def ordered_listing(df: DataFrame, order_by: Sequence[str | Column], name: str = "position") -> DataFrame:
    """A whole listing in a stated order (versions newest first, runbooks by
    name, members by key), each row with its 1-based position; the order is
    built over range partitions, never in one task."""
    out = with_row_index(df, order_by, name)
    return out.withColumn(name, F.col(name) + 1)
