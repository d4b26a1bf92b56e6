"""Worker results and step polling/retry decisions.

The result reducer is exact and skew-safe: instead of walking each step's
events in order inside one task, it finds the first terminal event among the
first success and the first few failures (a ranked cut per task) and then
labels every event relative to it on a salted key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventa.functions.durations import duration_seconds, seconds_between

# Result kinds.
RESULT_SUCCESS = "success"
RESULT_FAILURE = "failure"
RESULT_POLLING = "polling"
RESULT_HEARTBEAT = "heartbeat"
# tasks that a single step's results are spread over
SALTS = 16


def poll_action(status: Column, poll_started: Column, last_polled: Column, as_of: Column,
                interval: str | Column, timeout: str | Column) -> Column:
    """For a polling step — ``poll_timeout`` when polling started
    longer ago than the timeout, ``poll_due`` when the interval has passed
    since the last poll, else ``wait``."""
    iv = duration_seconds(interval if isinstance(interval, Column) else F.lit(interval))
    to = duration_seconds(timeout if isinstance(timeout, Column) else F.lit(timeout))
    return (F.when(status != "polling", F.lit(None).cast("string"))
             .when(seconds_between(as_of, poll_started) > to, F.lit("poll_timeout"))
             .when(F.timestamp_add("SECOND", iv, last_polled) <= as_of, F.lit("poll_due"))
             .otherwise(F.lit("wait")))


def retry_decision(retry_count: Column, step_max: Column, global_max: int | Column) -> Column:
    """retry while ``retry_count < max`` (a step's own limit overrides
    the global one)."""
    g = global_max if isinstance(global_max, Column) else F.lit(global_max)
    return F.when(retry_count < F.coalesce(step_max, g), F.lit("retry")).otherwise(F.lit("fail"))


def reduce_results(results: DataFrame, keys: Sequence[str], order_by: Sequence[str], kind_col: str,
                   max_retries: int = 2) -> DataFrame:
    """Fold each step's results in order.  ``success`` ends the step
    (succeeded); the ``max_retries+1``-th ``failure`` ends it (failed); earlier
    failures leave it ``retry_pending``; ``polling`` leaves it ``polling``;
    heartbeats change nothing.  Results after the terminal one are ignored.

    Returns per key: final status, applied and ignored result counts."""
    keys = list(keys)
    o = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)])
    kind = F.col(kind_col)
    r = results.select(*keys, kind.alias(kind_col), o.alias("_o"))
    # the first success and the first failures per key: ranked rows, which
    # Spark cuts to so many per key and task before the shuffle
    ends = r.filter(kind.isin(RESULT_SUCCESS, RESULT_FAILURE))
    rank = F.row_number().over(Window.partitionBy(*keys, kind_col).orderBy("_o"))
    firsts = ends.withColumn("_r", rank).filter(F.col("_r") <= max_retries + 1)
    term = firsts.groupBy(*keys).agg(
        F.min(F.when((kind == RESULT_SUCCESS) & (F.col("_r") == 1), F.col("_o"))).alias("_ok"),
        F.min(F.when((kind == RESULT_FAILURE) & (F.col("_r") == max_retries + 1), F.col("_o"))).alias("_fail"))
    term = term.select(*keys, "_ok", F.least("_ok", "_fail").alias("_t"))
    # the ends are joined on a salted key, so that a step holding most results
    # is labelled and counted by many tasks before its partial counts meet
    salted = term.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lab = (r.withColumn("_salt", F.pmod(F.xxhash64("_o"), F.lit(SALTS)).cast("int"))
           .join(salted, [*keys, "_salt"], "left"))
    after = F.col("_t").isNotNull() & (F.col("_o") > F.col("_t"))
    live = ~after & kind.isin(RESULT_SUCCESS, RESULT_FAILURE, RESULT_POLLING)
    part = lab.groupBy(*keys, "_salt").agg(
        F.first("_t", ignorenulls=True).alias("_t"), F.first("_ok", ignorenulls=True).alias("_ok"),
        F.count_if(live).alias("n_applied"), F.count_if(after).alias("n_ignored"),
        F.max(F.when(live, F.struct(F.col("_o"), kind.alias("k")))).alias("_last"))
    agg = part.groupBy(*keys).agg(
        F.first("_t", ignorenulls=True).alias("_t"), F.first("_ok", ignorenulls=True).alias("_ok"),
        F.sum("n_applied").alias("n_applied"), F.sum("n_ignored").alias("n_ignored"),
        F.max("_last")["k"].alias("_last"))
    status = (F.when(F.col("_t").isNotNull() & (F.col("_t") == F.col("_ok")), F.lit("succeeded"))
               .when(F.col("_t").isNotNull(), F.lit("failed"))
               .when(F.col("_last") == RESULT_FAILURE, F.lit("retry_pending"))
               .when(F.col("_last") == RESULT_POLLING, F.lit("polling"))
               .otherwise(F.lit("dispatched")))
    return agg.select(*keys, status.alias("final_status"), "n_applied", "n_ignored")
