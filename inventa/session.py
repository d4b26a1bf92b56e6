"""Session helpers: building a session for tests/bench and finding the shared folder.

Queries never depend on session settings made here; every operator is written
so that it gives the same answer under the driver's own session.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# A task that sorts or groups rows is given about so many of them.
ROWS_PER_TASK = 250_000
# One block of ``sized`` at a time in a session, so that each puts back what it found.
_SIZING: dict[str, threading.RLock] = {}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "inventa") -> SparkSession:
    """Session used by tests and bench.py (local mode)."""
    master = master or os.environ.get("INVENTA_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only when it is unset *and* we run in local
    mode (tests) do we pick our own folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="inventa-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a
    cluster).  Each call gets its own uuid so concurrent runs never collide."""
    base = ensure_checkpoint_dir(spark)
    # the checkpoint dir Spark hands back already holds a per-application uuid
    return "/".join([base, "inventa", *parts, uuid.uuid4().hex])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the provided parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows: one a core at first (no more than the session's
    shuffles have), then as many as ``ROWS_PER_TASK`` needs."""
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(cores, -(-rows // ROWS_PER_TASK))


@contextmanager
def sized(spark: SparkSession, rows: int, open_files: int = 0) -> Iterator[int]:
    """While the block runs, scans and shuffles of ``spark`` are dealt to
    :func:`tasks_for` tasks.  By themselves they follow compressed bytes, so that
    rows that compress well come by the million to one task.  With ``open_files``
    a task writes to so many folders at a time without sorting its rows by folder."""
    tasks = tasks_for(spark, rows)
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.files.minPartitionNum": str(tasks),
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    if open_files:
        wanted["spark.sql.maxConcurrentOutputFileWriters"] = str(open_files)
    with _SIZING.setdefault(spark._jsparkSession.sessionUUID(), threading.RLock()):
        before = {k: spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                spark.conf.set(k, v)
            yield tasks
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
