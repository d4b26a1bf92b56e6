"""Versioned parquet tables (S12-S14) and the keyed upsert that maintains them.

Delta is not available, so a silver table is a folder of versions.  Rows are
spread over ``buckets`` hash buckets of the key; a version only rewrites the
buckets its change set touches and points at older versions for the rest.
A version's bucket map is a tiny JSON file (at most ``buckets`` entries).
Readers never see a half-written version: the map is written last.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.operators.scd import latest_per_key, merge_latest
from inventa.session import scratch_path, sized

BUCKET_COL, HASH_COL, PART_COL, SIDE_COL = "_inventa_bucket", "_inventa_hash", "_inventa_part", "_inventa_side"
# A change set of at most this many rows (counted before the merge) is
# broadcast to the stored side — only its key and sequence columns are
# broadcast, so this bounds the broadcast to ~100 MB; larger change sets are
# reduced together with the stored rows.
BROADCAST_ROW_LIMIT = 1_000_000
# A bucket's rows are written by one task for each so many of them.
ROWS_PER_FILE = 250_000
# Parts of a bucket, by hash, whose rows are counted to find a key with many.
SLOTS = 256


def _jvm_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _jvm_path(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, jpath = _jvm_path(spark, path)
    if not fs.exists(jpath):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(jpath)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(_hash(keys), F.lit(buckets)).cast("int")


class VersionedTable:
    """A keyed parquet table with versions ``v000001, v000002, …``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str],
                 sequence_by: Sequence[str | Column], buckets: int = 16,
                 properties: dict[str, str] | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.sequence_by = list(sequence_by)
        self.buckets = buckets
        self.properties = dict(properties or {})
        self._last_change_rows = 0

    # -- versions ---------------------------------------------------------
    def _map_path(self, version: int) -> str:
        return f"{self.path}/_versions/{version:06d}.json"

    def versions(self) -> list[int]:
        fs, jpath = _jvm_path(self.spark, f"{self.path}/_versions")
        if not fs.exists(jpath):
            return []
        out = []
        for st in fs.listStatus(jpath):
            name = st.getPath().getName()
            if name.endswith(".json"):
                out.append(int(name[:-5]))
        return sorted(out)

    def latest_version(self) -> int:
        v = self.versions()
        return v[-1] if v else 0

    def _bucket_map(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "buckets": {}, "schema": None, "committed_at": None}
        text = _read_text(self.spark, self._map_path(version))
        if text is None:
            raise FileNotFoundError(f"no version {version} of {self.path}")
        bmap = json.loads(text)
        # the rows were dealt out by the table's own bucket count, which wins
        self.buckets = bmap.get("n_buckets", self.buckets)
        return bmap

    def history(self) -> list[dict]:
        return [{k: v for k, v in self._bucket_map(n).items() if k != "schema"} for n in self.versions()]

    def version_as_of(self, ts_epoch_seconds: float) -> int:
        """S13 time travel: the last version committed at or before ``ts``."""
        best = 0
        for n in self.versions():
            if self._bucket_map(n)["committed_at"] <= ts_epoch_seconds:
                best = n
        return best

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None,
             spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        version = self.latest_version() if version is None else version
        bmap = self._bucket_map(version)
        wanted = bmap["buckets"] if buckets is None else {
            str(b): bmap["buckets"][str(b)] for b in buckets if str(b) in bmap["buckets"]}
        if not wanted:
            if bmap["schema"] is None:
                raise ValueError(f"table {self.path} has no data yet")
            from pyspark.sql.types import StructType
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(bmap["schema"])))
        paths = [f"{self.path}/v{v:06d}/{BUCKET_COL}={b}" for b, v in sorted(wanted.items())]
        if bmap["schema"] is None:
            return spark.read.parquet(*paths)
        # files of older versions may lack columns that came later
        from pyspark.sql.types import StructType
        return spark.read.schema(StructType.fromJson(json.loads(bmap["schema"]))).parquet(*paths)

    # -- writes -----------------------------------------------------------
    def upsert(self, changes: DataFrame) -> int:
        """Merge ``changes`` (any number of rows per key) into a new
        version.  Only touched buckets are read and rewritten.  The changes are
        counted first: a task reduces a bounded number of rows, however many
        there are and however well they compress."""
        prev = self.latest_version()
        if prev:
            self._bucket_map(prev)  # takes over the stored bucket count
        spread = changes.select(bucket_of(self.keys, self.buckets).alias(BUCKET_COL),
                                F.shiftrightunsigned(_hash(self.keys), 32).bitwiseAND(SLOTS - 1).alias("slot"))
        # at most ``buckets`` times ``SLOTS`` counts come back
        counts = {(r[0], r[1]): r[2] for r in spread.groupBy(BUCKET_COL, "slot").count().collect()}
        rows = sum(counts.values())
        if prev == 0 or rows > BROADCAST_ROW_LIMIT:
            return self._rewrite(prev, changes, counts)
        latest = latest_per_key(changes, self.keys, self.sequence_by)
        return self.merge(latest, lambda cur, chg: merge_latest(
            cur, chg, self.keys, self.sequence_by, broadcast_changes=self._last_change_rows <= BROADCAST_ROW_LIMIT,
            changes_deduped=True), cluster_output=False, rows=rows)

    def _rewrite(self, prev: int, changes: DataFrame, counts: dict[tuple[int, int], int]) -> int:
        """Stored rows of the touched buckets and changes reduced together, in one
        shuffle, straight into the version's folder; at equal sequence a change
        wins.  ``counts`` are the changes by bucket and slot of the key's hash.

        Rows are dealt by bucket and hash before they are reduced, so a task has
        rows of one bucket, sorted by hash first: comparing numbers is what
        makes this fast.  Rows of a slot beyond a task's may be one key: then every task
        reduces its own rows before they are dealt."""
        touched = sorted({b for b, _ in counts})
        if not touched:
            return prev
        per_bucket = {b: sum(n for (x, _), n in counts.items() if x == b) for b in touched}
        bmap = self._bucket_map(prev)
        hit = [b for b in touched if str(b) in bmap["buckets"]]
        every, order = changes, list(self.sequence_by)
        if hit:
            # of the session of the changes, which plans both
            stored = self.read(prev, hit, changes.sparkSession)
            for r in stored.groupBy(bucket_of(self.keys, self.buckets)).count().collect():
                per_bucket[r[0]] += r[1]
            every = stored.withColumn(SIDE_COL, F.lit(0)).unionByName(changes.withColumn(SIDE_COL, F.lit(1)), allowMissingColumns=True)
            order.append(F.col(SIDE_COL))
        every = every.withColumn(BUCKET_COL, bucket_of(self.keys, self.buckets)).withColumn(HASH_COL, _hash(self.keys))
        groups = [HASH_COL, BUCKET_COL, *self.keys]
        if max(counts.values()) <= ROWS_PER_FILE:
            parts = max(1, -(-max(per_bucket.values()) // ROWS_PER_FILE))
            salt = F.pmod(F.xxhash64(F.lit(7), HASH_COL), F.lit(parts)).cast("int")
            every = every.withColumn(PART_COL, F.col(BUCKET_COL) * parts + salt)
            every = every.repartitionById(self.buckets * parts, F.col(PART_COL))
            groups.insert(1, PART_COL)
        with sized(changes.sparkSession, sum(per_bucket.values()), open_files=self.buckets):
            latest = latest_per_key(every, groups, order).drop(HASH_COL, PART_COL, SIDE_COL)
            return self._commit(prev, bmap, latest, touched)

    def merge(self, changes: DataFrame, combine, cluster_output: bool = True, rows: int | None = None) -> int:
        """Merge with a custom rule: ``combine(current_rows, changes)`` gets
        the stored rows of the touched buckets and the change rows and
        returns the new rows of those buckets (e.g. additive counters).

        The change set is dealt out by bucket and, in large buckets, by a
        salt, so the number of tasks follows the rows.  With ``cluster_output=False`` the
        merged rows are written where they are: stored rows keep the
        partitioning of the bucket files they were read from, so the stored
        side is never shuffled — at the price of more, smaller files, which
        :meth:`compact` folds back.  ``rows``, where known, is the number of rows
        that ``changes`` is reduced from."""
        if self.latest_version():
            self._bucket_map(self.latest_version())  # takes over the stored bucket count
        # the change set is written once to the shared folder: it is read
        # several times below, and survives lost executors
        aside = scratch_path(self.spark, "changes")
        with nullcontext() if rows is None else sized(changes.sparkSession, rows):
            changes.withColumn(BUCKET_COL, bucket_of(self.keys, self.buckets)).write.parquet(aside)
        latest = self.spark.read.parquet(aside)
        try:
            # one row per touched bucket comes back (≤ `buckets`): which
            # buckets to rewrite, and the change-set size that decides
            # whether the change side may be broadcast
            per_bucket = {r[0]: r[1] for r in latest.groupBy(BUCKET_COL).count().collect()}
            touched = sorted(per_bucket)
            self._last_change_rows = sum(per_bucket.values())
            if not touched:
                return self.latest_version()
            prev = self.latest_version()
            bmap = self._bucket_map(prev)
            hit = [b for b in touched if str(b) in bmap["buckets"]]
            if hit:
                current = self.read(prev, hit).withColumn(BUCKET_COL, bucket_of(self.keys, self.buckets))
                merged = combine(current, latest)
                if BUCKET_COL not in merged.columns:
                    merged = merged.withColumn(BUCKET_COL, bucket_of(self.keys, self.buckets))
                if cluster_output:
                    merged = self._dealt(merged, max(per_bucket.values()))
            else:
                merged = self._dealt(latest, max(per_bucket.values()))
            return self._commit(prev, bmap, merged, touched)
        finally:
            fs, jpath = _jvm_path(self.spark, aside)
            fs.delete(jpath, True)

    def _dealt(self, rows: DataFrame, largest: int) -> DataFrame:
        """Rows dealt to as many tasks as they need: a bucket of more than
        ``ROWS_PER_FILE`` rows is written by several.  Every task has rows of one
        bucket only (by number: under a hash several buckets would share a task)."""
        parts = max(1, -(-largest // ROWS_PER_FILE))
        salt = F.pmod(F.xxhash64(F.lit(7), *[F.col(k) for k in self.keys]), F.lit(parts)).cast("int")
        return rows.repartitionById(self.buckets * parts, F.col(BUCKET_COL) * parts + salt)

    def _commit(self, prev: int, bmap: dict, merged: DataFrame, touched: Sequence[int]) -> int:
        merged.write.mode("overwrite").partitionBy(BUCKET_COL).parquet(f"{self.path}/v{prev + 1:06d}")
        return self._publish(prev, bmap["buckets"], merged.drop(BUCKET_COL).schema.json(), touched)

    def _publish(self, prev: int, stored: dict, schema: str, touched: Sequence[int]) -> int:
        new = prev + 1
        buckets = dict(stored)
        buckets.update({str(b): new for b in touched})
        # the bucket map is written last: readers never see a half version
        _write_text(self.spark, self._map_path(new), json.dumps({
            "version": new, "buckets": buckets, "n_buckets": self.buckets, "schema": schema,
            "committed_at": time.time(), "properties": self.properties,
            "touched_buckets": len(touched)}))
        return new

    def compact(self, buckets: Sequence[int] | None = None) -> int:
        """Rewrite (some) buckets as few files each — the maintenance pass for
        tables written with ``cluster_output=False``.  A new version; older
        ones stay readable until vacuumed."""
        prev = self.latest_version()
        bmap = self._bucket_map(prev)
        chosen = sorted(int(b) for b in bmap["buckets"]) if buckets is None else list(buckets)
        if not chosen:
            return prev
        data = self.read(prev, chosen).withColumn(BUCKET_COL, bucket_of(self.keys, self.buckets))
        largest = max(r[1] for r in data.groupBy(BUCKET_COL).count().collect())
        return self._commit(prev, bmap, self._dealt(data, largest), chosen)

    def vacuum(self, keep_versions: int) -> list[int]:
        """Drop version folders no longer referenced by the last
        ``keep_versions`` versions (retention of the time-travel window)."""
        vs = self.versions()
        keep = vs[-keep_versions:] if keep_versions > 0 else vs[-1:]
        return self._drop_except(vs, keep)

    def vacuum_older_than(self, days: float, now: float | None = None) -> list[int]:
        """Keep every version committed in the last ``days`` days (and
        always the latest) — bronze keeps 90 days, silver 7."""
        cutoff = (now if now is not None else time.time()) - days * 86400
        vs = self.versions()
        keep = [n for n in vs if self._bucket_map(n)["committed_at"] >= cutoff] or vs[-1:]
        if vs and vs[-1] not in keep:
            keep.append(vs[-1])
        return self._drop_except(vs, keep)

    def _drop_except(self, vs: list[int], keep: list[int]) -> list[int]:
        referenced = set(keep)
        for n in keep:
            referenced.update(self._bucket_map(n)["buckets"].values())
        dropped = []
        for n in vs:
            if n not in referenced:
                fs, jpath = _jvm_path(self.spark, f"{self.path}/v{n:06d}")
                fs.delete(jpath, True)
                dropped.append(n)
        for n in vs:
            if n not in keep:
                fs, jpath = _jvm_path(self.spark, self._map_path(n))
                fs.delete(jpath, False)
        return dropped
