"""Landing files as Python data sources: the chunk sink (S20, S21, S23) and the
manifest reader (S22).

``landing_chunks`` writes rows ``(tenant, day, line)`` as text files in the
landing layout.  Every task writes its own files under their final names, as
hidden files until they are whole, and sends one commit message; the driver
never touches a file that a task wrote.  Names follow from the run and the
partition number, so a retried task replaces its own files.

``landing_manifests`` reads the hidden ``_manifest_*`` files that Spark's file
readers skip.  Its partitions are folders; the tasks list and parse them.

Paths may be plain or URIs of a file system that Arrow knows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark import TaskContext
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

# Manifest record fields.
MANIFEST_DDL = ("run_id string, tenant_key string, tenant_id string, entity_type string, "
                "phase1_record_count long, phase2_record_count long, phase2_chunk_count long, "
                "phase2_skipped_count long, started_at string, completed_at string, status string, "
                "errors array<string>, manifest_path string")
MANIFEST_FIELDS = [f.split(" ")[0] for f in MANIFEST_DDL.split(", ")]

CHUNK_DDL = "tenant string, day string, line string"

#: files that a task holds open
OPEN_FILES = 64

#: a third of the time of Arrow's level 9 and less, for files larger by half
GZIP_LEVEL = 3

#: folders of one manifest task
FOLDERS_PER_TASK = 16


def open_path(uri: str):
    """The file system of a path or URI and the path inside it."""
    from pyarrow import fs
    filesystem, inner = fs.FileSystem.from_uri(uri)
    return filesystem, inner.rstrip("/")


def output(filesystem, path: str, name: str):
    """A stream to ``path``, compressed if the file's final name says so."""
    stream = filesystem.open_output_stream(path, compression=None)
    return Gzip(stream) if name.endswith(".gz") else stream


class Gzip:
    """A stream that writes one gzip member to another."""

    def __init__(self, stream):
        self.stream, self.packer = stream, zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        self.stream.write(self.packer.compress(data))

    def close(self) -> None:
        self.stream.write(self.packer.flush())
        self.stream.close()


def folder_lines(batch) -> Iterator[tuple[str | None, str | None, object]]:
    """The lines of a batch of rows ``(tenant, day, line)``, each with its line
    end, as one buffer per tenant and day, in the order in which these begin.
    No row becomes a Python object."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if batch.num_rows == 0:
        return
    tenants, days, lines = (batch.column(i) for i in range(3))
    if lines.null_count:
        raise ValueError("a landing line is NULL")
    lines = pc.binary_join_element_wise(lines.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()),
                                        pa.scalar(b"\n", pa.large_binary()))
    keys = pc.binary_join_element_wise(tenants, days, "\0", null_handling="replace").dictionary_encode()
    order, ends = None, [batch.num_rows]
    if len(keys.dictionary) > 1:
        order = pc.sort_indices(keys.indices)  # stable; a key's code counts up as keys appear
        ends = pc.run_end_encode(keys.indices.take(order)).run_ends.to_pylist()
        lines = lines.take(order)
    offsets = memoryview(lines.buffers()[1]).cast("q")[lines.offset:]
    begin = 0
    for end in ends:
        row = begin if order is None else order[begin].as_py()
        yield tenants[row].as_py(), days[row].as_py(), lines.buffers()[2].slice(offsets[begin], offsets[end] - offsets[begin])
        begin = end



def entries(filesystem, folder: str, folders: bool) -> list[str]:
    """Names of the sub-folders, or of the files, of a folder (none if it is missing)."""
    from pyarrow import fs
    kind = fs.FileType.Directory if folders else fs.FileType.File
    listed = filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(i.base_name for i in listed if i.type == kind)


# --------------------------------------------------------------- writing --

@dataclass
class TaskFiles(WriterCommitMessage):
    """What one task published: its files per folder, and how many rows."""
    files: dict[str, str] = field(default_factory=dict)
    rows: int = 0


class ChunkSink(DataSource):
    """Options: ``root`` (the entity's folder), ``name`` (file name, in which
    ``*`` is the partition number), ``digits``, ``detail`` (sub-folder below the
    day), ``record`` (path of the run's record) and ``ordered`` (``true`` if the
    rows of a task come sorted by tenant and day)."""

    @classmethod
    def name(cls) -> str:
        return "landing_chunks"

    def schema(self) -> str:
        return CHUNK_DDL

    def writer(self, schema, overwrite) -> ChunkWriter:
        return ChunkWriter(dict(self.options))


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["root"], options["name"]
        self.digits, self.detail = int(options.get("digits", "3")), options.get("detail", "")
        self.record, self.ordered = options["record"], options.get("ordered", "true") == "true"

    def write(self, iterator) -> TaskFiles:
        """Rows that come sorted by tenant and day have one file open at a time; a
        file gets its name when the task has gone past it.  Otherwise the files of
        up to ``OPEN_FILES`` folders stay open; one that has to make room goes on
        in a further hidden piece, and the pieces become one file at the end."""
        context = TaskContext.get()
        name = self.pattern.replace("*", f"{context.partitionId():0{self.digits}d}")
        filesystem, base = open_path(self.root)
        done, pieces = TaskFiles(), {}
        opened: dict[str, object] = {}

        def hidden(folder: str, piece: int) -> str:
            return f"{base}/{folder}/.{name}.{context.taskAttemptId()}" + (f".{piece}" if piece else "")

        def stream(folder: str):
            out = opened.pop(folder, None)
            if out is None:
                if len(opened) >= OPEN_FILES:
                    opened.pop(next(iter(opened))).close()
                if folder not in pieces:
                    filesystem.create_dir(f"{base}/{folder}", recursive=True)
                pieces[folder] = pieces.get(folder, 0) + 1
                out = output(filesystem, hidden(folder, pieces[folder] - 1), name)
            opened[folder] = out  # the last used is the last to go
            return out

        def publish(folder: str) -> None:
            n = pieces.pop(folder)
            if folder in opened:
                opened.pop(folder).close()
            if n > 1:
                with filesystem.open_output_stream(hidden(folder, n), compression=None) as whole:
                    for i in range(n):
                        with filesystem.open_input_stream(hidden(folder, i), compression=None) as part:
                            while block := part.read(1 << 20):
                                whole.write(block)
                for i in range(n):
                    filesystem.delete_file(hidden(folder, i))
            filesystem.move(hidden(folder, n if n > 1 else 0), f"{base}/{folder}/{name}")
            done.files[folder] = name

        for batch in iterator:
            for tenant, day, lines in folder_lines(batch):
                folder = "/".join(p for p in (tenant, day, self.detail) if p)
                if self.ordered and folder not in pieces:
                    for past in list(pieces):
                        publish(past)
                stream(folder).write(lines)
            done.rows += batch.num_rows
        for folder in list(pieces):
            publish(folder)
        return done

    def commit(self, messages) -> None:
        """Drops what an earlier run of the same id left (fewer partitions or
        other folders now), and the hidden files of lost attempts, by one listing
        a folder; then records the folders of this run."""
        filesystem, base = open_path(self.root)
        written: dict[str, set[str]] = {}
        for m in messages:
            for folder, name in (m.files.items() if m else ()):
                written.setdefault(folder, set()).add(name)
        for folder in sorted({*written, *self._recorded()}):
            for name in entries(filesystem, f"{base}/{folder}", folders=False):
                ours = fnmatch(name, self.pattern) or fnmatch(name, f".{self.pattern}.*")
                if ours and name not in written.get(folder, ()):
                    filesystem.delete_file(f"{base}/{folder}/{name}")
        records, path = open_path(self.record)
        records.create_dir(path.rsplit("/", 1)[0], recursive=True)
        totals = {"folders": sorted(written), "files": sum(map(len, written.values())),
                  "rows": sum(m.rows for m in messages if m)}
        with records.open_output_stream(path) as f:
            f.write(json.dumps(totals).encode("utf-8"))

    def abort(self, messages) -> None:
        """A failed run takes back the files that its finished tasks published."""
        filesystem, base = open_path(self.root)
        for m in messages:
            for folder, name in (m.files.items() if m else ()):
                filesystem.delete_file(f"{base}/{folder}/{name}")

    def _recorded(self) -> list[str]:
        records, path = open_path(self.record)
        try:
            with records.open_input_stream(path) as f:
                return json.loads(f.read())["folders"]
        except FileNotFoundError:
            return []


# --------------------------------------------------------------- reading --

@dataclass
class Folders(InputPartition):
    """Some ``entity/tenant`` folders."""
    paths: list[str]


class ManifestSource(DataSource):
    """Options: ``root`` (the landing folder), ``pattern`` (file names)."""

    @classmethod
    def name(cls) -> str:
        return "landing_manifests"

    def schema(self) -> str:
        return MANIFEST_DDL

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(dict(self.options))


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["root"].rstrip("/"), options.get("pattern", "_manifest_*.json")
        self.per_task = int(options.get("folders_per_task", str(FOLDERS_PER_TASK)))

    def partitions(self) -> list[Folders]:
        """Only entity and tenant folders are listed here."""
        filesystem, base = open_path(self.root)
        tenants = [f"{entity}/{tenant}" for entity in entries(filesystem, base, folders=True) if not entity.startswith(".")
                   for tenant in entries(filesystem, f"{base}/{entity}", folders=True)]
        # tenants are dealt in turn, so the folders of one entity spread over the tasks
        n = max(1, -(-len(tenants) // self.per_task))
        return [Folders(tenants[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        filesystem, base = open_path(self.root)
        for tenant in partition.paths:
            for day in entries(filesystem, f"{base}/{tenant}", folders=True):
                for name in entries(filesystem, f"{base}/{tenant}/{day}", folders=False):
                    if fnmatch(name, self.pattern):
                        with filesystem.open_input_stream(f"{base}/{tenant}/{day}/{name}") as f:
                            yield manifest_row(f.read(), f"{self.root}/{tenant}/{day}/{name}")


def manifest_row(content: bytes, path: str) -> tuple:
    """One manifest as a row; a file that is no JSON object gives a row with
    status ``unreadable``, a field of another type is null."""
    try:
        rec = json.loads(content.decode("utf-8-sig"))
    except ValueError as e:
        rec = e
    if not isinstance(rec, dict):
        rec = {"status": "unreadable", "errors": [str(rec) if isinstance(rec, ValueError) else "no JSON object"]}

    def value(name: str):
        v = rec.get(name)
        if name.endswith("_count"):
            return v if isinstance(v, int) and not isinstance(v, bool) else None
        if name == "errors":
            given = v if isinstance(v, list) else [] if v is None else [v]
            return [e if isinstance(e, str) else json.dumps(e) for e in given if e is not None]
        return v if isinstance(v, str) else None

    return (*(value(n) for n in MANIFEST_FIELDS[:-1]), path)
