"""Latest-state-per-key (SCD type 1) as DataFrame operations.

``latest_per_key`` is the batch form of the upsert: for each key keep the row
with the greatest ordering tuple.  It is written as a hash aggregate
(``max_by`` over a struct) rather than a ``row_number`` window so that Spark
does a map-side partial aggregation: a key that holds a third of all rows is
reduced inside every map task before the shuffle instead of landing whole in
one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys`` — the one with the largest ``order_by`` tuple.

    NULL ordering values count as smallest.  Callers pass enough tie-breakers
    to make the choice total (e.g. ``[seq, source_file, event_id]``)."""
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(_as_cols(order_by))])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def merge_latest(target: DataFrame, changes: DataFrame, keys: Sequence[str],
                 sequence_by: Sequence[str | Column], broadcast_changes: bool = False,
                 changes_deduped: bool = False) -> DataFrame:
    """Upsert ``changes`` into ``target`` by ``keys``.

    A change replaces the stored row when its sequence is greater than or
    equal to the stored one (so a replayed batch is idempotent, T4); a lower
    sequence never overwrites (T3).  Keys absent from ``changes`` are kept —
    there is no delete (T5)."""
    # Written as joins keyed by the change set, not as union + group-by over
    # both sides: the stored side is only probed (keys and sequence columns
    # first, then an anti join).  ``broadcast_changes`` is set by callers that
    # counted the change set (VersionedTable.merge): then the change side is
    # broadcast and the large stored side is never shuffled; otherwise AQE
    # picks the join from runtime sizes.
    keys = list(keys)
    seq = F.struct(*_as_cols(sequence_by))
    chg = changes.withColumn("_inventa_seq", seq)
    if not changes_deduped:
        chg = latest_per_key(chg, keys, [F.col("_inventa_seq")])
    stored = target.select(*[F.col(k).alias(f"_inventa_t_{k}") for k in keys], seq.alias("_inventa_tseq"))
    small = F.broadcast if broadcast_changes else (lambda d: d)
    # changes that lose to a newer stored row: an inner join, so the change
    # side can be the broadcast (build) side and the stored side streams by
    chg_keys = chg.select(*keys, "_inventa_seq")
    losers = (stored.join(small(chg_keys), _null_safe(chg_keys, stored, keys, "_inventa_t_"), "inner")
              .filter(F.col("_inventa_tseq") > F.col("_inventa_seq"))
              .select(*[F.col(k).alias(f"_inventa_l_{k}") for k in keys]))
    winners = chg.join(losers, _null_safe(chg, losers, keys, "_inventa_l_"), "left_anti").drop("_inventa_seq")
    won = winners.select(*[F.col(k).alias(f"_inventa_w_{k}") for k in keys])
    kept = target.join(small(won), _null_safe(target, won, keys, "_inventa_w_"), "left_anti")
    return kept.unionByName(winners, allowMissingColumns=True)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"{prefix}{k}"])
        cond = c if cond is None else cond & c
    return cond


def scd_key(*parts: str | Column) -> Column:
    """The surrogate key ``concat_ws('_', tenant, id...)``.  NULL parts are
    skipped (so it is only a label — merges run on the component columns)."""
    return F.concat_ws("_", *_as_cols(parts))


def absent_keys(previous: DataFrame, latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T5: keys present in an earlier snapshot but missing from the latest one
    (the upsert keeps them; this lists them)."""
    prev = previous.select(*keys).distinct()
    now = latest.select(*[F.col(k).alias(f"_inventa_n_{k}") for k in keys]).distinct()
    return prev.join(now, _null_safe(prev, now, keys, "_inventa_n_"), "left_anti")
