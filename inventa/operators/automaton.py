"""Ordered folds of finite automata as a distributed scan.

A request moves an entity from one of a few states to another, or leaves it
where it is: it is a function on the states.  Functions compose associatively,
so a prefix of an entity's requests is one small table (state -> state), and the
prefixes of all requests are a scan over the requests in order of entity and
time.  The rows are range-partitioned by entity and order and cut into blocks of
``BLOCK_ROWS``; each block is scanned on its own, the blocks' last runs are
scanned in the same way one level up, and their result enters the next block.
An entity that holds most of the requests thus spreads over many tasks, and no
entity's requests meet in one place.

The state before the first request is state 0.  Stored states enter the scan as
a request that precedes all others and maps every state to the stored one, so
they need no join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventa.session import scratch_path

BLOCK_ROWS = 1 << 16


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "automaton")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def constant(states: int, state: Column) -> Column:
    """The map of ``states`` states that always ends in ``state`` (an index)."""
    return F.unhex(F.repeat(F.lpad(F.hex(state.cast("long")), 2, "0"), F.lit(states).cast("int")))


def as_map(targets: Sequence[int]) -> Column:
    """The literal map with the given target of each state."""
    return F.lit(bytearray(bytes(targets)))


def _composed(maps: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Inclusive scan: row i becomes the composition of the rows of its segment
    up to i (doubling steps)."""
    n, at = len(maps), np.arange(len(maps))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], segment[1:] != segment[:-1])), at, 0)) if n else at
    longest = int((at - first).max()) if n else 0
    d = 1
    while d <= longest:
        use = np.flatnonzero(at - first >= d)
        out = maps.copy()
        out[use] = np.take_along_axis(maps[use], maps[use - d].astype(np.int64), axis=1)
        maps, d = out, 2 * d
    return maps


def _block(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(order of the rows, segment numbers, inclusive maps, keys) of one block."""
    seq = batch.column("_seq").to_numpy()
    by = np.argsort(seq, kind="stable")
    keys = batch.column("_key").combine_chunks()
    code = keys.dictionary_encode()
    code = (code.combine_chunks() if hasattr(code, "combine_chunks") else code).indices.to_numpy(zero_copy_only=False)[by]
    maps = np.array([np.frombuffer(m, dtype=np.uint8) for m in batch.column("_map").to_pylist()])[by]
    return by, code, _composed(maps, code), keys


def _prefixes(rows: DataFrame, states: int, block_rows: int) -> DataFrame:
    """(_seq, _before): the composition of the maps of the same ``_key`` that
    precede each row of (_key, _seq, _map)."""
    single = rows.count() <= block_rows
    rows = rows.withColumn("_block", F.lit(0).cast("long") if single else F.expr(f"_seq div {block_rows}"))
    identity = np.arange(states, dtype=np.uint8)

    def last_run(batch):
        import pyarrow as pa

        by, code, maps, keys = _block(batch)
        return pa.table({"_key": [keys[int(by[-1])].as_py()], "_seq": batch.column("_block").to_pylist()[:1],
                         "_map": pa.array([maps[-1].tobytes()], pa.binary()),
                         "_first": [keys[int(by[0])].as_py()]})

    def before(batch, entering):
        import pyarrow as pa

        if not batch.num_rows:
            return pa.table({"_seq": pa.array([], pa.int64()), "_before": pa.array([], pa.binary())})
        by, code, maps, _ = _block(batch)
        out = np.tile(identity, (len(by), 1))
        same = np.flatnonzero(code[1:] == code[:-1]) + 1
        out[same] = maps[same - 1]
        if entering.num_rows:
            start = np.frombuffer(entering.column("_enter")[0].as_py(), dtype=np.uint8)
            run = np.flatnonzero(code == code[0])
            out[run] = out[run][:, start]
        return pa.table({"_seq": batch.column("_seq").to_numpy()[by], "_before": pa.array([m.tobytes() for m in out], pa.binary())})

    if single:
        return rows.groupBy("_block").applyInArrow(
            lambda batch: before(batch, batch.slice(0, 0)), "_seq long, _before binary")
    runs = _stored(rows.groupBy("_block").applyInArrow(last_run, "_key string, _seq long, _map binary, _first string"))
    # what enters a block: the scan over the last runs before it, where these are of its first key.  A row of
    # each block's first key stands in the sequence just before that block's own last run.
    marks = (runs.select("_key", (F.col("_seq") * 2 + 1).alias("_seq"), "_map")
             .unionByName(runs.select(F.col("_first").alias("_key"), (F.col("_seq") * 2).alias("_seq"), as_map(identity).alias("_map"))))
    entering = (_prefixes(marks, states, block_rows).where("_seq % 2 = 0")
                .select(F.expr("_seq div 2").alias("_block"), F.col("_before").alias("_enter")))
    return rows.groupBy("_block").cogroup(entering.groupBy("_block")).applyInArrow(before, "_seq long, _before binary")


def scan(requests: DataFrame, key: Sequence[str], order: Sequence[str], maps: Column, states: int,
         stored: DataFrame | None = None, stored_state: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``requests`` with ``state_before``, the index of the state
    their entity is in when they arrive.

    ``maps`` gives each request's function as ``states`` bytes.  ``stored`` has
    the key columns and ``stored_state`` of known entities; others start in 0.
    Requests of one entity that are equal in ``order`` come in the order of all
    their columns, so a replay gives the same answer."""
    if not 0 < states <= 256:
        raise ValueError("an automaton has 1 to 256 states")
    own = F.to_json(F.struct(*[F.col(f"`{k}`") for k in key]), {"ignoreNullFields": "false"})
    whole = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    rows = requests.select(own.alias("_key"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("_order"),
                           maps.alias("_map"), whole.alias("_row"))
    if stored is not None:
        known = stored.select(own.alias("_key"), F.lit(0).alias("_kind"), constant(states, stored_state).alias("_map"))
        rows = rows.unionByName(known, allowMissingColumns=True)
    tie = F.xxhash64("_row")
    ordered = (rows.withColumn("_tie", tie).repartitionByRange(F.col("_key"), F.col("_kind"), F.col("_order"), F.col("_tie"))
               .sortWithinPartitions("_key", "_kind", "_order", "_tie", F.to_json("_row")).withColumn("_seq", F.monotonically_increasing_id()))
    ordered = _stored(ordered.select("_key", "_seq", "_map", "_kind", "_row"))
    found = _prefixes(ordered.select("_key", "_seq", "_map"), states, block_rows)
    first = F.conv(F.hex(F.substring("_before", 1, 1)), 16, 10).cast("int")
    return (ordered.where("_kind = 1").join(found, "_seq")
            .select("_row.*", first.alias("state_before")))
