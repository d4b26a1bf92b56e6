"""Benchmark decontamination by a hash set of normalised word n-grams.

Texts are normalised to words (A-Z lower-cased; runs of digits, letters a-z and
non-ASCII characters).  Every window of ``n`` consecutive benchmark words, or a
whole shorter item, is put in a set of 64-bit hashes.  Tasks slide windows of
those lengths over whole training texts, look their hashes up and verify each
hit word by word.  Words inside an occurring window are hit.

The set is broadcast while the benchmark's texts have at most
``broadcast_bytes`` bytes (the size is measured first).  A larger benchmark is
split by window hash into slices of that size and the texts are scanned once
per slice; the hit spans of the slices are united per row.

Defined cases: null, empty and wordless texts and items have no words and no
windows; items of equal text each count; items with a null id count as the
empty id; repeated rows are treated alike; an empty benchmark hits nothing;
other columns of either table, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.session import table

WINDOW = 10
BROADCAST_BYTES = 16 << 20


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends)."""
    low = T.LOWER[buf]
    return (low, *T.word_spans(low, T.ALNUM))


class WindowSet:
    """Hashes of benchmark windows, with the words and items to verify hits."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.by_size: dict[int, np.ndarray] = {}
        self.windows: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = {}
        found: dict[int, list[int]] = {}
        for item, text in items:
            low, start, end = words_of(np.frombuffer(text, dtype=np.uint8))
            if not len(start):
                continue
            size = min(n, len(start))
            words = [low[a:b].tobytes() for a, b in zip(start, end)]
            for k, h in enumerate(T.ngram_hashes(T.span_hashes(low, start, end), size).tolist()):
                same = self.windows.setdefault((size, h), [])
                content = b" ".join(words[k:k + size])
                entry = next((e for e in same if e[0] == content), None)
                if entry is None:
                    same.append((content, [item]))
                elif item not in entry[1]:
                    entry[1].append(item)
                found.setdefault(size, []).append(h)
        for size, hashes in found.items():
            self.by_size[size] = np.unique(np.array(hashes, dtype=np.uint64))

    @classmethod
    def of(cls, by_size, windows) -> WindowSet:
        """A set from its plain parts, the form in which it is broadcast (a
        class of this package could not be read by a worker without it)."""
        out = cls([], 0)
        out.by_size, out.windows = by_size, windows
        return out

    def verified(self, size: int, h: int, content: bytes) -> list[str] | None:
        return next((items for c, items in self.windows[size, h] if c == content), None)


def _within(value: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Positions of the values that the ascending array holds.  A table of the
    hashes' low bits rules most values out before the binary search."""
    bits = np.uint64((1 << max(16, int(len(ordered)).bit_length() + 5)) - 1)
    seen = np.zeros(int(bits) + 1, dtype=bool)
    seen[ordered & bits] = True
    maybe = np.flatnonzero(seen[value & bits])
    at = np.minimum(np.searchsorted(ordered, value[maybe]), len(ordered) - 1)
    return maybe[ordered[at] == value[maybe]]


def scan(texts: list[bytes], windows: WindowSet):
    """Per text: (number of words, hit words, items, [(start, end) of hit words
    joined where they are neighbours, in bytes])."""
    for lo, hi, buf, starts in T.chunks(texts):
        low, start, end = words_of(buf)
        doc = T.doc_of(start, starts)
        word = T.span_hashes(low, start, end)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        hit = np.zeros(len(word) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        for size, hashes in windows.by_size.items():
            for k in _within(T.ngram_hashes(word, size), hashes).tolist():
                if doc[k] != doc[k + size - 1]:
                    continue
                content = b" ".join(low[start[j]:end[j]].tobytes() for j in range(k, k + size))
                h = int(T.ngram_hashes(word[k:k + size], size)[0])
                found = windows.verified(size, h, content)
                if found is not None:
                    hit[k] += 1
                    hit[k + size] -= 1
                    items.setdefault(int(doc[k]), set()).update(found)
        covered = np.cumsum(hit)[:-1] > 0
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            spans = []
            if i in items:
                edge = np.diff(np.concatenate(([0], covered[a:b].astype(np.int8), [0])))
                spans = [(int(start[a + x] - starts[i]), int(end[a + y - 1] - starts[i]))
                         for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            yield int(b - a), int(covered[a:b].sum()), items.get(i, set()), spans


def _slices(benchmark: DataFrame, n: int, broadcast_bytes: int) -> list[WindowSet]:
    """The benchmark as one set, or as several of bounded size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    parts = int(size // broadcast_bytes) + 1
    out = []
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        out.append(WindowSet([(r["item"], r["text"].encode()) for r in part.collect()], n))
    return out


def _apply(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_bytes: int, fields: str, make) -> DataFrame:
    """The rows with the columns that ``make`` gives from each text's scans, one
    per slice of the benchmark, which a task holds one after the other."""
    shared = [docs.sparkSession.sparkContext.broadcast((s.by_size, s.windows)) for s in _slices(benchmark, n, broadcast_bytes)]
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = [f.split()[1] for f in fields.split(", ")]

    def run(batches):
        import pyarrow as pa

        arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        sets = [WindowSet.of(*b.value) for b in shared]
        for batch in T.sliced(batches):
            texts = T.as_bytes(batch.column(names.index("text")))
            rows = [make(t, s) for t, s in zip(texts, zip(*(scan(texts, w) for w in sets)))]
            more = [pa.array([r[k] for r in rows], arrow[kind]) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *(f.split()[0] for f in fields.split(", "))])

    return docs.mapInArrow(run, f"{schema}, {fields}")


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _summary(text: bytes, scans) -> tuple:
    spans = _united([s for scan in scans for s in scan[3]])
    if len(scans) == 1:
        hit = scans[0][1]
    else:
        hit = sum(len(words_of(np.frombuffer(text[a:b], dtype=np.uint8))[1]) for a, b in spans)
    items = sorted(set().union(*(s[2] for s in scans)))
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return scans[0][0], hit, len(items), digest, hit > 0


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    fields = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _apply(docs.select("doc_id", "text"), benchmark, n, broadcast_bytes, fields, _summary).drop("text")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with every hit span cut out of ``text``; all else is kept."""
    def cut(text: bytes, scans) -> tuple:
        at, parts = 0, []
        for a, b in _united([s for scan in scans for s in scan[3]]):
            parts.append(text[at:a])
            at = b
        return ((b"".join(parts) + text[at:]).decode() if at else None,)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    clean = _apply(rows, benchmark, n, broadcast_bytes, "cleaned string", cut)
    return clean.select(*[F.coalesce("cleaned", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`")
                          for c in docs.columns])


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
                     broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows without any hit."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    fields = "hit boolean"
    return (_apply(rows, benchmark, n, broadcast_bytes, fields, lambda t, scans: (any(s[1] for s in scans),))
            .where(~F.col("hit")).select("row.*"))


_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS gram
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(k)),
hits AS (SELECT doc_id, k, dw.size AS size, item FROM dw JOIN bw USING (size, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + size)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op5_decontamination", _SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark window in every whole document."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
