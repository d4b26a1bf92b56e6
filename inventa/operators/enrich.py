"""Per-item enrichment (T22, X1, X2) and device/mailbox joins.

The per-item work function is user code that Spark cannot express (in the
reference, a remote call per item).  It runs in ``mapInPandas`` on Arrow
batches of a partitioned id list; each item yields one outcome row
``(ok, category, error, …)`` instead of failing the task, so one bad item
never fails a job and retries stay at Spark's task level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inventa.functions.text import EMPTY_GUID

OUTCOME_FIELDS = "ok boolean, category string, error string"

ItemFn = Callable[[pd.DataFrame], pd.DataFrame]


def enrich_items(items: DataFrame, work: ItemFn, output_ddl: str, key_cols: Sequence[str],
                 partitions: int | None = None) -> DataFrame:
    """Apply ``work`` (pandas in → pandas out, one output row per
    input row with ``ok``, ``category``, ``error`` and its own fields) to
    every item.  ``partitions`` spreads the items (round robin by key hash)
    like the reference's worker slices."""
    src = items if partitions is None else items.repartition(partitions, *[F.col(k) for k in key_cols])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*key_cols).schema.fields),
                        OUTCOME_FIELDS, output_ddl])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = work(pdf)
            yield out

    return src.mapInPandas(run, schema)


def attach_managed(devices: DataFrame, managed: DataFrame, device_key: str, managed_key: str) -> DataFrame:
    """Devices left-joined to their managed-device summary; no match →
    status ``Skipped`` with a reason; all-zero ids never match."""
    dk = F.col(device_key)
    valid = dk.isNotNull() & (F.lower(dk) != EMPTY_GUID)
    m = managed.withColumnRenamed(managed_key, "_mk").withColumn("_hit", F.lit(True))
    x = devices.join(m, valid & (dk == F.col("_mk")), "left")
    return (x.withColumn("status", F.when(F.col("_hit"), F.lit("Enriched")).otherwise(F.lit("Skipped")))
             .withColumn("reason", F.when(F.col("_hit"), F.lit(None).cast("string"))
                         .when(~valid, F.lit("no device id")).otherwise(F.lit("no managed device")))
             .drop("_mk", "_hit"))


def copy_key_down(parent: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Child rows (folder statistics) carry the parent's key (mailbox id)."""
    return children.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "inner")
