"""Landing zone: JSON-lines files laid out as
``{root}/{entity}/{tenant}/{YYYY-MM-DD}/{entity}_{run}.jsonl`` (Phase 1) and
``{root}/{entity}/{tenant}/{YYYY-MM-DD}/{detail_type}/chunk-NNN_{run}.jsonl``
(Phase 2), read as incremental file streams for all tenants at once.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa import session
from inventa.session import sized
from inventa.sources.chunks import ChunkSink

# The tenant folder sits right above a YYYY-MM-DD folder;
# the default file pattern and the source-system label of landed rows.
TENANT_PATH_PATTERN = r"/([^/]+)/\d{4}-\d{2}-\d{2}/"
DEFAULT_FILE_PATTERN = "*.{jsonl,jsonl.gz}"
DEFAULT_SOURCE_SYSTEM = "graph_api"

MEGABYTE = 1 << 20

#: folder of rows without a tenant or day
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

META_COLUMNS = ("_tenant_key", "_source_file", "_source_system", "_dlt_ingested_at")


def landing_glob(root: str, entity: str, detail_type: str | None = None, levels: int = 2) -> str:
    """Phase-1 files are exactly two levels (tenant, date) below the
    entity folder; a Phase-2 detail type is one more level down.  Spark's file
    source does not recurse, so ``*/*/`` never picks up Phase-2 files.  Run
    history has only a date level (``levels=1``)."""
    base = f"{root.rstrip('/')}/{entity}/" + "*/" * levels
    return f"{base}{detail_type}/" if detail_type else base


def tenant_from_path(path: Column) -> Column:
    """Tenant key = folder above the date folder, NULL when absent.
    ``_metadata.file_path`` is a URI, so the folder name is percent-decoded
    (a literal ``+`` is kept)."""
    raw = F.regexp_extract(path, TENANT_PATH_PATTERN, 1)
    return F.nullif(F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit(""))


def with_metadata(df: DataFrame, source_system: str = DEFAULT_SOURCE_SYSTEM,
                  tenant_from_dir: bool = True, glob: str | None = None) -> DataFrame:
    """The four metadata columns (file path comes from ``_metadata``); ``glob``
    names the folders that the files are in."""
    path = F.col("_metadata.file_path")
    tenant = tenant_from_path(_varying(path, glob)) if tenant_from_dir else F.lit(None).cast("string")
    return (df.withColumn("_tenant_key", tenant)
              .withColumn("_source_file", path)
              .withColumn("_source_system", F.lit(source_system))
              .withColumn("_dlt_ingested_at", F.current_timestamp()))


def _varying(path: Column, glob: str | None) -> Column:
    """The end of a path in which its date folder must be: the pattern is searched
    in every row, and most of a path is the landing folder's.  The whole path where
    that may have a date folder itself, which then comes first."""
    fixed, star, rest = (glob or "").partition("/*/")
    whole = "/" + fixed + "/"
    if (not star or not re.match(r"/|\w[\w+.-]*:/", fixed) or re.search(r"[*?\[{]", fixed)
            or re.search(r"/\d{4}-\d{2}-\d{2}/", whole)):
        return path
    # the folder above the first that varies, with the slash before it, to the file
    return F.concat(F.lit("/"), F.substring_index(path, "/", -(star + rest).count("/") - 1))


def read_landing(spark: SparkSession, root: str, entity: str, schema: T.StructType | str,
                 detail_type: str | None = None, file_pattern: str = DEFAULT_FILE_PATTERN,
                 source_system: str = DEFAULT_SOURCE_SYSTEM, streaming: bool = True,
                 tenant_from_dir: bool = True, levels: int = 2, max_files: int | None = None) -> DataFrame:
    """Incremental JSONL read for all tenants of ``entity``.

    A declared schema is required (a file stream cannot infer one), which also
    makes an empty or missing landing folder a valid 0-row source."""
    glob = landing_glob(root, entity, detail_type, levels)
    if not streaming and not _glob_matches(spark, glob):
        # a batch read of a glob matching nothing fails; a stream just waits
        empty = spark.createDataFrame([], schema)
        return (empty.withColumn("_tenant_key", F.lit(None).cast("string"))
                .withColumn("_source_file", F.lit(None).cast("string"))
                .withColumn("_source_system", F.lit(source_system))
                .withColumn("_dlt_ingested_at", F.current_timestamp()))
    reader = spark.readStream if streaming else spark.read
    df = (_paced(reader, max_files if streaming else None).schema(schema)
          .option("pathGlobFilter", file_pattern)
          .option("mode", "PERMISSIVE")
          .json(glob))
    return with_metadata(df, source_system, tenant_from_dir, glob)


def _paced(reader, max_files: int | None):
    """The reader with at most ``max_files`` new files per micro-batch."""
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def _glob_matches(spark: SparkSession, glob: str) -> bool:
    """Driver-side listing of the folders a glob names (metadata only)."""
    fs, jpath = _fs(spark, glob)
    found = fs.globStatus(jpath)
    return found is not None and len(found) > 0


def infer_schema(spark: SparkSession, root: str, entity: str, detail_type: str | None = None,
                 file_pattern: str = DEFAULT_FILE_PATTERN, fallback: T.StructType | None = None,
                 sampling_ratio: float = 1.0) -> T.StructType:
    """Batch-infer the schema of what has landed so far (to freeze it for
    the stream); fall back to the declared schema when nothing landed yet."""
    try:
        df = (spark.read.option("pathGlobFilter", file_pattern)
              .option("samplingRatio", sampling_ratio)
              .json(landing_glob(root, entity, detail_type)))
        schema = df.schema
    except AnalysisException as e:
        if fallback is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return fallback
    schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    if not schema.fields:
        if fallback is None:
            raise ValueError("nothing to infer from")
        return fallback
    return schema


def read_landing_rescued(spark: SparkSession, root: str, entity: str, schema: T.StructType,
                         detail_type: str | None = None, file_pattern: str = DEFAULT_FILE_PATTERN,
                         source_system: str = DEFAULT_SOURCE_SYSTEM,
                         streaming: bool = True, tenant_from_dir: bool = True, levels: int = 2,
                         max_files: int | None = None) -> DataFrame:
    """Parse every line with the declared schema and keep the top-level
    fields the schema does not know as a JSON object ``_rescued_data``
    (NULL when there are none).  A line that is no JSON object is kept whole
    as ``{"_corrupt_record": line}``; blank lines are no records."""
    glob = landing_glob(root, entity, detail_type, levels)
    reader = spark.readStream if streaming else spark.read
    raw = (_paced(reader, max_files if streaming else None).format("text").option("pathGlobFilter", file_pattern)
           .load(glob)).where(F.trim("value") != "")
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    as_map = F.from_json(F.col("value"), "map<string,string>")
    extra = F.map_filter(as_map, lambda k, v: ~F.array_contains(known, k))
    unknown = F.size(F.array_except(F.json_object_keys("value"), known)) > 0
    parsed = raw.select(F.from_json(F.col("value"), schema).alias("_rec"), "value", "_metadata")
    out = parsed.select(
        "_rec.*",
        F.when(_written_alike(schema), F.lit(None))
         .when(F.try_parse_json("value").isNull(), F.to_json(F.struct(F.col("value").alias("_corrupt_record"))))
         .when(unknown, F.when(F.size(extra) > 0, F.to_json(extra))).alias("_rescued_data"),
        "_metadata")
    return with_metadata(out, source_system, tenant_from_dir, glob).drop("_metadata")


def _written_alike(schema: T.StructType) -> Column:
    """The record ``_rec`` is written as the very text that it was read from: such a
    line is sound and has known fields only, and need not be read again to
    see that.  A line may be sound without it (other order, blanks, NULLs)."""
    if _has_map(schema):  # the only type that keeps a key that comes twice
        return F.lit(False)
    # a far longer text may be beyond what counts as sound
    return (F.octet_length("value") < MEGABYTE) & (F.to_json("_rec", {"ignoreNullFields": "true"}) == F.col("value"))


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and _has_map(t.elementType)


def read_legacy_wrapper(spark: SparkSession, path_glob: str, record_schema: T.StructType) -> DataFrame:
    """One multi-line JSON object per file with a ``data`` array and
    in-file metadata; tenant = in-file ``tenant_name`` else the path tenant."""
    wrapper = T.StructType([
        T.StructField("tenant_name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("data", T.ArrayType(record_schema)),
    ])
    df = spark.read.schema(wrapper).option("multiLine", True).json(path_glob)
    path = F.col("_metadata.file_path")
    return df.select(
        F.explode("data").alias("_rec"),
        F.coalesce(F.col("tenant_name"), tenant_from_path(path)).alias("_tenant_key"),
        F.col("run_id").alias("_run_id"),
        path.alias("_source_file"),
    ).select("_rec.*", "_tenant_key", "_run_id", "_source_file")


# ---------------------------------------------------------------- writing --

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def write_landing(df: DataFrame, root: str, entity: str, tenant_col: str | None, date_col: str,
                  run_id: str, detail_type: str | None = None, chunk_prefix: str | None = None,
                  num_files: int | None = None, compress: bool = False) -> None:
    """Land ``df`` as JSONL in the landing layout.

    The tasks write their files under final names through the chunk sink; the
    driver gets one message a task and touches no file.  ``num_files`` deals the
    rows round-robin over that many slices, whose number is in the file name
    (S20).  Without a tenant column only the date level is written (run
    history, S23).  With ``compress`` the files are ``.jsonl.gz``.  A rerun of a run id replaces all that run left; rows
    without a tenant or day go to folder ``__HIVE_DEFAULT_PARTITION__``."""
    base = entity.rsplit("/", 1)[-1]
    run_id = f"{run_id}.jsonl" + (".gz" if compress else "")
    name, digits = (f"{chunk_prefix}-*_{run_id}", 3) if chunk_prefix else (f"{base}_*_{run_id}", 5)
    if num_files is not None:
        # round-robin chunks; few slices hold many rows each: their files are
        # written as the rows come
        write_lines(df.repartition(num_files), root, entity, tenant_col, date_col, name, digits, detail_type, ordered=False)
        return
    # range-partition on (tenant, date, row hash): each task holds a
    # contiguous slice, so it writes few files, and a tenant holding a
    # third of the rows is still split over many tasks
    groups = [F.col(c) for c in (tenant_col, date_col) if c is not None]
    rows = df.count()
    with sized(df.sparkSession, rows) as tasks:
        if _lies_well(df, groups, rows):
            write_lines(df, root, entity, tenant_col, date_col, name, digits, detail_type, ordered=False)
            return
        out = df.repartitionByRange(tasks, *groups, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        write_lines(out, root, entity, tenant_col, date_col, name, digits, detail_type)


def _lies_well(df: DataFrame, groups: list[Column], rows: int) -> bool:
    """The tasks of ``df`` as it lies may land it: its rows keep all cores busy, no
    task has far too many, and they are of few tenants and days, so that the files
    are few.  Only the columns of ``groups`` are read for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows < cores * session.ROWS_PER_TASK:
        return False
    files = df.groupBy(F.spark_partition_id().alias("_task"), *[g.alias(f"_g{i}") for i, g in enumerate(groups)]).count()
    per_task = files.groupBy("_task").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("files"))
    largest, n_files = per_task.agg(F.max("n"), F.sum("files")).first()
    even = largest <= 2 * session.ROWS_PER_TASK and cores * largest <= rows
    many = largest <= 5 * session.ROWS_PER_TASK and 3 * cores * largest <= rows
    return (even or many) and n_files * session.ROWS_PER_TASK <= 8 * rows


def write_lines(df: DataFrame, root: str, entity: str, tenant_col: str | None, date_col: str, name: str,
                digits: int = 3, detail_type: str | None = None, ordered: bool = True) -> None:
    """The rows of every partition of ``df``, one JSON line each, to one file per
    tenant and day; ``*`` in ``name`` is the partition number.  With
    ``ordered`` a task sorts its rows and has one file open at a time; without, it
    holds no rows back and keeps the files of several folders open."""
    spark = df.sparkSession
    spark.dataSource.register(ChunkSink)
    root = root.rstrip("/")

    def folder(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(NO_VALUE))

    rest = [F.col(f"`{c}`") for c in df.columns if c not in (tenant_col, date_col)]
    record = f"{root}/.landed/" + "-".join([entity.replace("/", "-"), detail_type or "", name.replace("*", "n")]) + ".json"
    lines = df.select(F.lit("").alias("tenant") if tenant_col is None else folder(tenant_col).alias("tenant"),
                      F.when(folder(date_col) == NO_VALUE, NO_VALUE).otherwise(F.substring(folder(date_col), 1, 10)).alias("day"),
                      F.to_json(F.struct(*rest)).alias("line"))
    if ordered:
        lines = lines.sortWithinPartitions("tenant", "day")
    (lines.write.format(ChunkSink.name()).mode("append")
     .option("root", f"{root}/{entity}").option("name", name).option("digits", digits).option("ordered", str(ordered).lower())
     .option("detail", detail_type or "").option("record", record).save())
