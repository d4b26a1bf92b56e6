"""Dispatch lists: members in ordered blocks of bounded size.

A message names many members, and one batch may hold a third of all members, so
a list is cut into numbered blocks.  Positions come from the distributed row
index; a group's start reaches its rows by slabs of the index, never by one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventa.operators.listing import with_row_index
from inventa.operators.phases import pending_and_due

#: members of one message block
BLOCK = 1000
#: rows of the index that share a join key
SLAB = 65_536

# Kinds of member messages.
MEMBER_ADDED, MEMBER_REMOVED = "member-added", "member-removed"


def ordered_blocks(rows: DataFrame, keys: Sequence[str], order_by: str, block: int = BLOCK) -> DataFrame:
    """Per group of ``keys`` its ``order_by`` values in ascending order, repeated
    ones kept, as rows ``(keys, block_no from 0, n_blocks, n_members, members)`` of at
    most ``block`` values; null keys are a group, null values come first and are
    left out of ``members``.  No rows give no blocks.

    A row's slab is its index // ``SLAB``; a group's start is repeated for each slab that
    the group touches, so no join key holds more than ``SLAB`` rows, and a
    group's blocks are separate keys of the last shuffle."""
    named = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(order_by).alias("_value"))
    ks = [f"_k{i}" for i in range(len(keys))]
    indexed = with_row_index(named, [*ks, "_value"], "_index")
    starts = (indexed.groupBy(*ks).agg(F.min("_index").alias("_start"), F.count(F.lit(1)).alias("n_members"))
              .select("*", F.explode(F.sequence(F.floor(F.col("_start") / SLAB),
                                                F.floor((F.col("_start") + F.col("n_members") - 1) / SLAB))).alias("_slab")))
    s, r = starts.alias("s"), indexed.withColumn("_slab", F.floor(F.col("_index") / SLAB)).alias("r")
    same = F.col("r._slab") == F.col("s._slab")
    for k in ks:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    placed = r.join(s, same).select(*[F.col(f"r.{k}") for k in ks], "_value", "_index", "n_members",
                                    F.floor((F.col("_index") - F.col("_start")) / block).alias("block_no"))
    lists = placed.groupBy(*ks, "block_no", "n_members").agg(
        F.array_sort(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_index", "_value")))).alias("_l"))
    return lists.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "block_no",
                        F.ceil(F.col("n_members") / block).alias("n_blocks"), "n_members",
                        F.transform("_l", lambda x: x["_value"]).alias("members"))


def due_phase_messages(phases: DataFrame, members: DataFrame, as_of: Column, member_id: str = "member_id",
                       block: int = BLOCK) -> dict[str, DataFrame]:
    """``messages``, one row per block of members for every pending phase that
    is due at ``as_of`` (all columns of the phase, block_no, n_blocks, n_members,
    members), and ``phases`` after it: the emitted ones are ``dispatched``.

    Members are the active ones of the phase's ``batch_id``; a phase whose batch has
    none is not emitted and stays pending.  A batch's blocks are built once for all
    its phases and met by (batch, block), so a batch of many members is no hot key."""
    active = members.filter(F.col("status") == "active").filter(F.col("batch_id").isNotNull())
    blocks = ordered_blocks(active, ["batch_id"], member_id, block)
    sizes = blocks.filter(F.col("block_no") == 0).select("batch_id", "n_blocks")
    due = pending_and_due(phases, as_of).join(sizes, "batch_id")
    wanted = due.select(*phases.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block_no"))
    messages = wanted.join(blocks, ["batch_id", "block_no"])
    has = sizes.select("batch_id", F.lit(True).alias("_has"))
    ready = (F.col("status") == "pending") & (F.col("due_at") <= as_of) & F.col("_has")
    after = (phases.join(has, "batch_id", "left")
             .withColumn("status", F.when(ready, F.lit("dispatched")).otherwise(F.col("status")))
             .select(*phases.columns))
    return {"messages": messages.select(*phases.columns, "block_no", "n_blocks", "n_members", "members"), "phases": after}


def member_messages(stored: DataFrame, current: DataFrame, as_of: Column, block: int = BLOCK) -> dict[str, DataFrame]:
    """One sync of stored batches with their current query result.

    ``stored`` has batch_id, member_key, status (active, removed, failed),
    add_dispatched_at and remove_dispatched_at, one row per batch and member;
    ``current`` batch_id and member_key (repeats count once, keys compare without
    case).  Only batches of which ``current`` still has a row are compared.

    ``messages``: per batch, in ordered blocks, (step, kind): 0 additions and 1
    removals that were stored but never dispatched, then 2 members added and 3
    removed by this result.  A stored active member missing from the result that
    was never dispatched is in 0 and in 3, as both messages are due.
    ``members``: the table after it, all emitted messages marked with ``as_of``;
    a removed or failed member that is back is active again and undispatched for
    removal."""
    cur = (current.select("batch_id", F.lower("member_key").alias("_key")).distinct().withColumn("_now", F.lit(True)))
    touched = cur.select("batch_id").distinct().withColumn("_touched", F.lit(True))
    sto = stored.select("batch_id", "member_key", "status", "add_dispatched_at", "remove_dispatched_at",
                        F.lower("member_key").alias("_key")).join(touched, "batch_id", "left")
    both = sto.join(cur, ["batch_id", "_key"], "full_outer")
    active, removed = F.coalesce(F.col("status") == "active", F.lit(False)), F.col("status") == "removed"
    now = F.coalesce(F.col("_now"), F.lit(False))
    retry_add = active & F.col("add_dispatched_at").isNull()
    retry_remove = F.coalesce(removed, F.lit(False)) & F.col("remove_dispatched_at").isNull()
    added, dropped = now & ~active, active & ~now & F.coalesce(F.col("_touched"), F.lit(False))
    steps = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind")))
                                      for i, (cond, kind) in enumerate([(retry_add, MEMBER_ADDED), (retry_remove, MEMBER_REMOVED),
                                                                        (added, MEMBER_ADDED), (dropped, MEMBER_REMOVED)])]))
    name = F.coalesce("member_key", "_key")
    due = both.select("batch_id", name.alias("member_key"), F.explode(steps).alias("_m")).select("batch_id", "member_key", "_m.*")
    after = both.select(
        "batch_id", name.alias("member_key"),
        F.when(added, F.lit("active")).when(dropped, F.lit("removed")).otherwise(F.col("status")).alias("status"),
        F.when(retry_add | added, as_of).otherwise(F.col("add_dispatched_at")).alias("add_dispatched_at"),
        F.when(added, F.lit(None)).when(retry_remove | dropped, as_of).otherwise(F.col("remove_dispatched_at"))
         .alias("remove_dispatched_at"))
    return {"messages": ordered_blocks(due, ["batch_id", "step", "kind"], "member_key", block), "members": after}
