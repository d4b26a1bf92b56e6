"""Run manifests and run history.

Spark's file readers skip files whose names start with ``_`` even when named
explicitly, and the collectors write ``_manifest_{run}.json``.  So manifests
are written and read by the data sources of ``chunks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.sources.chunks import FOLDERS_PER_TASK, ManifestSource


def read_manifests(spark: SparkSession, landing_root: str, pattern: str = "_manifest_*.json",
                   folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """Every manifest under ``{entity}/{tenant}/{date}/`` as rows; the
    driver lists entities and tenants, the tasks the days and files below."""
    spark.dataSource.register(ManifestSource)
    return (spark.read.format(ManifestSource.name()).option("root", landing_root).option("pattern", pattern)
            .option("folders_per_task", folders_per_task).load())


def write_manifests(records: DataFrame, root: str, entity: str, tenant_col: str, date_col: str, run_id: str) -> None:
    """One ``_manifest_{run}.json`` per tenant and day of ``entity``.
    ``records`` has one row per tenant and day; these columns only name the
    folder, so a record that shall carry its tenant has it in another column too."""
    from inventa.sources.landing import write_lines
    write_lines(records.repartition(F.col(tenant_col), F.col(date_col)), root, entity, tenant_col, date_col,
                f"_manifest_{run_id}.json")


def manifest_records(outcomes: DataFrame, run_id: str, keys: tuple[str, ...] = ("tenant_key", "entity_type"),
                     status_col: str = "status", error_col: str = "error", max_errors: int = 50) -> DataFrame:
    """Item outcomes → one manifest row per (run, tenant, entity)
    with counts, the first ``max_errors`` errors and, if there are others, how
    many more."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col(error_col))
    first = (outcomes.filter(F.col(error_col).isNotNull()).withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= max_errors)
             .groupBy(*keys).agg(F.array_sort(F.collect_list(error_col)).alias("errors")))
    st = F.col(status_col)
    counts = outcomes.groupBy(*keys).agg(
        F.count_if(st == "processed").alias("phase2_record_count"),
        F.count_if(st == "skipped").alias("phase2_skipped_count"),
        F.count_if(st == "failed").alias("failed_count"),
        F.count(error_col).alias("_errors"))
    more = F.when(F.col("_errors") > max_errors, F.array(F.concat(
        F.lit("… "), (F.col("_errors") - max_errors).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return (counts.join(first, list(keys), "left").withColumn("errors", F.concat("errors", more)).drop("_errors")
            .withColumn("run_id", F.lit(run_id))
            .withColumn("status", F.when(F.col("failed_count") > 0, "completed_with_errors").otherwise("completed")))


def write_history(df: DataFrame, root: str, kind: str, date_col: str, run_id: str) -> None:
    """run/task history as JSONL under ``_orchestrator/{kind}/{date}/``."""
    from inventa.sources.landing import write_landing
    write_landing(df, root, f"_orchestrator/{kind}", None, date_col, run_id)
