"""Fill-in-middle transformation over a compressed set of cut positions.

A text's units are the matches of ``[A-Za-z]+|[^A-Za-z]``; the set of their end
offsets (code points) is kept in roaring fashion: one container per 65,536
offsets, each an array, a bitmap or a list of runs, whichever is least, with the
cumulative cardinalities of the containers beside them.  The end of the k-th
unit is a select: a search of the cumulative cardinalities finds the container,
a local select finds the offset in it.  Both cuts of a text are two selects.

The cuts, the form and the ids depend on the document's id alone, so a text is
transformed alike wherever it is.

Defined cases: a null text is empty; empty texts and texts that hold a mark are
``plain``; a null doc_id counts as the empty string in the hash and any other
type by its decimal or string form; repeated rows are transformed alike; an
empty table gives no rows; other columns are ignored; a text of any length is
one set, with a container per 65,536 offsets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.session import table

SPAN = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
PLAIN_PERCENT = 10
SPM_PERCENT = 20


class ArrayContainer:
    """Ascending 16-bit values."""

    def __init__(self, low: np.ndarray):
        self.values = low.astype(np.uint16)
        self.bytes = 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit per value, with the number of set bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.bytes = SPAN // 8

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        word, left = int(self.words[w]), k - int(self.before[w])
        for _ in range(left):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


class RunContainer:
    """Maximal runs (first value, length), with the number of values before each."""

    def __init__(self, first: np.ndarray, size: np.ndarray):
        self.first = first.astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        self.bytes = 4 * len(first)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[r]) + k - int(self.before[r])


def container(low: np.ndarray):
    """The least of the three forms for the (ascending, distinct) values."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(low) != 1)))
    runs = 4 * len(new)
    if runs < min(2 * len(low), SPAN // 8):
        return RunContainer(low[new], np.diff(np.concatenate((new, [len(low)]))))
    return ArrayContainer(low) if 2 * len(low) <= SPAN // 8 else BitmapContainer(low)


class BoundarySet:
    """Ascending distinct offsets with select."""

    def __init__(self, offsets: np.ndarray):
        high = offsets // SPAN
        new = np.flatnonzero(np.concatenate(([len(offsets) > 0], np.diff(high) != 0)))
        ends = np.concatenate((new[1:], [len(offsets)]))
        self.keys = high[new]
        self.containers = [container(offsets[a:b] % SPAN) for a, b in zip(new, ends)]
        self.cumulative = np.concatenate(([0], ends)) if len(new) else np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        c = int(np.searchsorted(self.cumulative, k, side="right")) - 1
        return int(self.keys[c]) * SPAN + self.containers[c].select(k - int(self.cumulative[c]))

    def cut(self, units: int) -> int:
        """Offset after the first ``units`` members (0 after none)."""
        return self.select(units - 1) if units else 0


def boundaries(text: str) -> BoundarySet:
    """End offsets of the units of a text: everywhere but inside a word."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lower = code | 32
    letter = (lower >= 97) & (lower <= 122) & (code < 128)
    inside = letter[:-1] & letter[1:]
    return BoundarySet(np.flatnonzero(np.concatenate((~inside, [True]))) + 1 if len(code) else np.zeros(0, dtype=np.int64))


def transform(doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix code points, middle code points, output)."""
    units = boundaries(text)
    n = len(units)
    digest = hashlib.sha256((SEED + doc_id).encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    a, b = sorted((units.cut(h[0] % (n + 1)), units.cut(h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text, from the output and its form alone (no part holds a mark)."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head[len(PREFIX):].split(SUFFIX)
    else:
        suffix, prefix = head[len(SUFFIX):].split(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output and restored."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in T.sliced(batches, 256):
            made = [transform(i, t) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n, form, prefix, middle, output = map(list, zip(*made)) if made else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string()),
                 pa.array(list(map(restore, form, output)), pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, "
                                "output string, restored string")


@register("op13_fill_in_middle", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
k AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT doc_id, text, t, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM k),
p AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle,
         array_to_string(t[b + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the transformed and restored text of every whole document."""
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "utf-8"), 256).alias("output_sha256"),
        F.sha2(F.encode("restored", "utf-8"), 256).alias("restored_sha256"))
