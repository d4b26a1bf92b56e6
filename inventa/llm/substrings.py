"""Exact removal of long repeated substrings, by a sparse suffix array.

A byte is removed where some string of ``LENGTH`` bytes that covers it also
starts anywhere else, in the same text or another.

1. Every window of ``LENGTH`` bytes has an *anchor*: its least ``GRAM``-byte
   gram by hash (the leftmost of equals).  Equal windows have equal anchors at
   equal offsets, so only suffixes that start at anchors are indexed: about one
   in 130 bytes.  The windows with one anchor form its *block*.
2. Blocks of equal content are counted first, in partial sums per task: each of
   a block's windows is a repeat where the block occurs twice.  One instance
   then stands for all copies, however many there are.
3. Anchors whose gram occurs in blocks of different content are compared byte
   by byte: their suffixes are range-partitioned by their leading bytes, with
   splitters sampled from the data, and each bucket sorts its suffixes (and the
   reversed texts before the anchors) by multikey quicksort.  Neighbours in the
   two orders give common lengths, and a window repeats where another suffix
   shares its bytes after the anchor and before it.  Equal leading bytes fall in
   one bucket, so no pair is cut by a boundary.
4. A gram with more than ``HOT`` different blocks would overfill a bucket: its
   windows are dealt by a hash of the whole window instead, with partial counts,
   which compares them across all buckets and needs no task to hold the gram.

:func:`remove` can also count the words of repeated passages: those covered by
some ``words`` consecutive words that also start anywhere else, however many
bytes they have.  Nothing is removed for them.  Words are the lower-cased runs
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` and compared by 64-bit hashes; windows of
words get anchors and blocks as in 1 and 2, and blocks of different content
under one gram compare the hashes of their windows.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing;
repeated rows are copies of each other, so all their windows repeat; the answer
is one row per input row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.llm.storage import stored
from inventa.session import table

LENGTH = 400
GRAM = 128
HOT = 4096
LEAD = 16
WORDS = 50
WORD_GRAM = 10
ROWS_AT_ONCE = 16_384
_AT_BITS = np.uint64(30)
_AT_MASK = np.uint64((1 << 30) - 1)


def rolling(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the bytes, or other units, [i, i + gram) for each i."""
    n = len(buf)
    if n < gram:
        return np.zeros(0, dtype=np.uint64)
    power = T.powers(n + 1)
    inverse = T.powers(n + 1, np.uint64(pow(int(T.WORD_BASE), -1, 1 << 64)))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return T.mix((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text, anchor, first window, last window, gram hash) arrays per chunk,
    positions within the text."""
    for lo, _, buf, starts in T.chunks(texts):
        doc, at, first, last, h = _anchored(buf, starts, length, gram)
        if len(doc):
            base = starts[doc]
            yield lo + doc, at - base, first - base, last - base, h


def _anchored(buf: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, gram hash) of a chunk of bytes
    or other units, positions within the chunk; one unit follows each text."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) <= length:
        return none, none, none, none, none.view(np.uint64)
    h = rolling(buf, gram)
    order = (h >> _AT_BITS << _AT_BITS) | np.arange(len(h), dtype=np.uint64)
    own = sliding_min(order, length - gram + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = starts[1:] - 1
    window = np.arange(min(len(own), len(buf) - length + 1))
    window = window[window + length <= ends[doc[window]]]
    if not len(window):
        return none, none, none, none, none.view(np.uint64)
    at = (own[window] & _AT_MASK).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[window[1:]] != doc[window[:-1]]))))
    first = window[new]
    last = window[np.concatenate((new[1:], [len(window)])) - 1]
    return doc[first], at[new], first, last, h[at[new]]


def _word_units(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk with one more unit after each text, and the offset
    of each text's words."""
    low = T.LOWER[buf]
    start, end = T.word_spans(low, T.ALNUM)
    doc = T.doc_of(start, starts)
    begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(starts) - 1) + 1)))
    units = np.zeros(begin[-1], dtype=np.uint64)
    units[np.arange(len(start)) + doc] = T.span_hashes(low, start, end)
    return units, begin


def _uid(doc_id, text):
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.coalesce(text, F.lit("")), doc_id.isNull())


def _instances(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per anchor: gram, block (content hash), uid, place (anchor, first
    and last offset packed in one integer)."""
    def index(batches):
        import pyarrow as pa

        for batch in T.sliced(batches):
            texts, uid = T.as_bytes(batch.column(1)), np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for doc, at, first, last, h in anchors(texts, length, gram):
                block = np.array([int.from_bytes(hashlib.blake2b(
                    texts[d][a:b + length], digest_size=8, key=b"%d" % (p - a)).digest(), "little", signed=True)
                    for d, p, a, b in zip(doc.tolist(), at.tolist(), first.tolist(), last.tolist())], dtype=np.int64)
                place = (at << 20) | ((at - last) << 10) | (at - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(block), pa.array(uid[doc]), pa.array(place)],
                    ["gram", "block", "uid", "place"])

    return docs.mapInArrow(index, "gram long, block long, uid long, place long")


def _word_instances(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """One row per anchor among the words: gram, block (content hash), uid, place
    (first window and number of windows packed in one integer)."""
    def index(batches):
        import pyarrow as pa

        for batch in T.sliced(batches):
            texts, uid = T.as_bytes(batch.column(1)), np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for lo, _, buf, starts in T.chunks(texts):
                units, begin = _word_units(buf, starts)
                doc, at, first, last, h = _anchored(units, begin, words, gram)
                if not len(doc):
                    continue
                # sums of the block's units times powers counted from its first
                total = np.zeros(len(units) + 1, dtype=np.uint64)
                np.cumsum((units + np.uint64(1)) * T.powers(len(units)), out=total[1:])
                inverse = T.powers(len(units), np.uint64(pow(int(T.WORD_BASE), -1, 1 << 64)))
                size, ahead = (last - first + 1).astype(np.uint64), (at - first).astype(np.uint64)
                block = T.mix(T.mix((total[last + words] - total[first]) * inverse[first]) ^ ((size << np.uint64(32)) | ahead))
                place = ((first - begin[doc]) << 20) | (last - first + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(block.view(np.int64)), pa.array(uid[lo + doc]), pa.array(place)],
                    ["gram", "block", "uid", "place"])

    return docs.mapInArrow(index, "gram long, block long, uid long, place long")


def _contents(docs: DataFrame, wanted: DataFrame, length: int, gram: int, words: int) -> DataFrame:
    """The wanted instances with their content and leading bytes; for those of
    words the hashes of their windows, eight bytes each."""
    def cut(batches):
        import pyarrow as pa

        for batch in T.sliced(batches, 64):
            out = {"uid": [], "place": [], "gram": [], "n": [], "m": [], "of_words": [], "lead": [], "content": []}
            for uid, text, found in zip(*(batch.column(k) for k in range(3))):
                raw = (text.as_py() or "").encode()
                windows = None
                for w in found.as_py():
                    out["uid"].append(uid.as_py())
                    if w["of_words"]:
                        if windows is None:
                            units, _ = _word_units(*next(T.chunks([raw]))[2:])
                            windows = rolling(units, words).tobytes()
                        first, size = w["place"] >> 20, w["place"] & 0xFFFFF
                        out["lead"].append(b"")
                        out["content"].append(windows[8 * first:8 * (first + size)])
                    else:
                        at, low, high = w["place"] >> 20, w["place"] >> 10 & 1023, w["place"] & 1023
                        out["lead"].append(raw[at:at + min(LEAD, gram)])
                        out["content"].append(raw[at - high:at - low + length])
                    for k in ("place", "gram", "n", "m", "of_words"):
                        out[k].append(w[k])
            kinds = {"lead": pa.binary(), "content": pa.binary(), "of_words": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("place", "gram", "n", "m", "of_words")).alias("found"))
    rows = docs.join(lists, "uid").select("uid", "text", "found")
    schema = "uid long, place long, gram long, n long, m long, of_words boolean, lead binary, content binary"
    return rows.mapInArrow(cut, schema).dropDuplicates(["uid", "place", "of_words"])


def multikey_order(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (group, words), by three-way partition on one word
    after the other among the rows that still tie; and the number of leading
    words in which each row equals the row before it (-1: another group)."""
    order = np.argsort(group, kind="stable")
    same = np.concatenate(([-1], np.where(group[order][1:] == group[order][:-1], 0, -1)))
    for d in range(words.shape[1]):
        tied = same >= d
        member = tied | np.concatenate((tied[1:], [False]))
        at = np.flatnonzero(member)
        if not len(at):
            break
        part = np.cumsum(~tied)[at]
        key = words[order[at], d]
        by = np.lexsort((key, part))
        order[at] = order[at[by]]
        key = key[by]
        equal = np.concatenate(([False], (key[1:] == key[:-1]) & (part[1:] == part[:-1])))
        same[at[equal]] = d + 1
    return order, same


def _common(group: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common leading bytes with the row before; -1: another group)."""
    width = -(-width // 8) * 8
    raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)
    words = raw.view(">u8").astype(np.uint64)
    order, same = multikey_order(group, words)
    sorted_raw = raw[order]
    common = np.where(same < 0, -1, same * 8)
    part = np.flatnonzero((same >= 0) & (same < words.shape[1]))
    if len(part):
        cols = same[part][:, None] * 8 + np.arange(8)
        diff = np.take_along_axis(sorted_raw[part], cols, 1) != np.take_along_axis(sorted_raw[part - 1], cols, 1)
        common[part] += np.argmax(diff, axis=1)
    return order, common


def repeats(gram_of: np.ndarray, place: np.ndarray, contents: list[bytes], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """Per row: (first, last) window offsets before the anchor that repeat in
    another row of the same gram."""
    low, high = place >> 10 & 1023, place & 1023
    reach = length - gram
    _, group = np.unique(gram_of, return_inverse=True)
    after = _common(group, [c[h + gram:] for c, h in zip(contents, high.tolist())], reach)
    before = _common(group, [c[:h][::-1] for c, h in zip(contents, high.tolist())], reach)
    n = len(group)
    found = np.zeros((n, reach + 1), dtype=bool)
    kind = np.empty((2, n), dtype=np.int64)
    for o in range(reach + 1):
        active = np.flatnonzero((low <= o) & (o <= high))
        if len(active) < 2:
            continue
        for k, ((order, common), least) in enumerate(((after, reach - o), (before, o))):
            kind[k, order] = np.cumsum((common < least) | (common < 0))
        key = kind[0, active] * (n + 1) + kind[1, active]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        twice = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        found[active[by[twice]], o] = True
    out = []
    for row in found:
        edge = np.diff(np.concatenate(([0], row.astype(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())))
    return out


def _compared(blocks: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeats among the suffixes of each bucket: (uid, a, b) byte spans."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        import pyarrow as pa

        def spans(rows):
            g, place = np.array(rows[0], dtype=np.int64), np.array(rows[1], dtype=np.int64)
            uid, a, b = [], [], []
            for u, p, n, found in zip(rows[2], rows[1], rows[3], repeats(g, place, rows[4], length, gram)):
                if n == 1:
                    for first, last in found:
                        uid.append(u)
                        a.append((p >> 20) - last)
                        b.append((p >> 20) - first + length)
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                              ["uid", "a", "b"])

        held: list[list] = [[] for _ in range(5)]
        for batch in T.sliced(batches, 4096):
            for k in range(5):
                held[k].extend(batch.column(k).to_pylist())
            if len(held[0]) >= ROWS_AT_ONCE and held[0][0] != held[0][-1]:
                cut = held[0].index(held[0][-1])
                yield spans([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held[0]:
            yield spans(held)

    rows = (blocks.repartitionByRange(tasks, "lead", "gram").sortWithinPartitions("lead", "gram")
            .select("gram", "place", "uid", "n", "content"))
    return rows.mapInArrow(compare, "uid long, a long, b long")


def _hot_windows(blocks: DataFrame, length: int) -> DataFrame:
    """Repeats of the windows of grams with very many blocks: (uid, a, b)."""
    def explode(batches):
        import pyarrow as pa

        for batch in T.sliced(batches, 64):
            uid, a, h1, h2, n = [], [], [], [], []
            for u, place, k, content in zip(*(batch.column(c).to_pylist() for c in range(4))):
                first = (place >> 20) - (place & 1023)
                for s in range(len(content) - length + 1):
                    d = hashlib.blake2b(content[s:s + length], digest_size=16).digest()
                    uid.append(u)
                    a.append(first + s)
                    h1.append(int.from_bytes(d[:8], "little", signed=True))
                    h2.append(int.from_bytes(d[8:], "little", signed=True))
                    n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, a, h1, h2, n)], ["uid", "a", "h1", "h2", "n"])

    windows = stored(blocks.select("uid", "place", "n", "content")
                     .mapInArrow(explode, "uid long, a long, h1 long, h2 long, n long"), "windows")
    twice = stored(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"), "twice")
    return (windows.where("n = 1").join(twice, ["h1", "h2"])
            .select("uid", "a", (F.col("a") + length).alias("b")))


def _compared_words(blocks: DataFrame, words: int) -> DataFrame:
    """Repeats among the windows of words of each gram: (uid, a, b) word spans."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        import pyarrow as pa

        def spans(rows):
            size = np.array([len(c) // 8 for c in rows[4]], dtype=np.int64)
            row = np.repeat(np.arange(len(size)), size)
            a = np.arange(len(row)) - np.repeat(np.cumsum(size) - size - (np.array(rows[1], dtype=np.int64) >> 20), size)
            key, g = np.frombuffer(b"".join(rows[4]), dtype=np.uint64), np.array(rows[0], dtype=np.int64)[row]
            by = np.lexsort((key, g))
            equal = (key[by][1:] == key[by][:-1]) & (g[by][1:] == g[by][:-1])
            twice = by[np.concatenate(([False], equal)) | np.concatenate((equal, [False]))]
            twice = np.sort(twice[np.array(rows[3], dtype=np.int64)[row[twice]] == 1])
            # windows one after the other are one span
            new = np.concatenate(([True], (np.diff(twice) != 1) | (np.diff(row[twice]) != 0)))[:len(twice)]
            end = np.concatenate((new[1:], [True]))[:len(twice)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(rows[2], dtype=np.int64)[row[twice[new]]]), pa.array(a[twice[new]]), pa.array(a[twice[end]] + words)],
                ["uid", "a", "b"])

        held: list[list] = [[] for _ in range(5)]
        for batch in T.sliced(batches, 4096):
            for k in range(5):
                held[k].extend(batch.column(k).to_pylist())
            if len(held[0]) >= ROWS_AT_ONCE and held[0][0] != held[0][-1]:
                cut = held[0].index(held[0][-1])
                yield spans([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held[0]:
            yield spans(held)

    rows = blocks.repartitionByRange(tasks, "gram").sortWithinPartitions("gram").select("gram", "place", "uid", "n", "content")
    return rows.mapInArrow(compare, "uid long, a long, b long")


def _hot_words(blocks: DataFrame, words: int) -> DataFrame:
    """The same for grams with very many blocks: their windows are counted."""
    windows = stored(blocks.select("gram", "uid", "n", F.shiftright("place", 20).alias("first"), "content",
                                   F.explode(F.expr("sequence(0L, (place & 1048575) - 1)")).alias("k"))
                     .select("gram", F.expr("substring(content, int(8 * k + 1), 8)").alias("h"), "uid", "n", (F.col("first") + F.col("k")).alias("a")),
                     "word_windows")
    twice = stored(windows.groupBy("gram", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "h"), "word_twice")
    return windows.where("n = 1").join(twice, ["gram", "h"]).select("uid", "a", (F.col("a") + words).alias("b"))


def _word_blocks(texts: DataFrame, words: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(uid, a, b) word spans of blocks that occur twice, and the blocks to be
    compared, one instance each."""
    found = stored(_word_instances(texts, words, gram), "word_anchors")
    grams = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), (F.min("block") != F.max("block")).alias("mixed"))
                   .where("c > 1").select("gram", "mixed"), "word_grams")
    live = stored(found.join(grams, "gram"), "word_live")
    blocks = stored(live.where("mixed").groupBy("gram", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"), F.min_by("place", "uid").alias("place")), "word_blocks")
    copied = blocks.where("n > 1").select("gram", "block")
    whole = live.where("not mixed").select("uid", "place").unionByName(
        live.where("mixed").join(copied, ["gram", "block"]).select("uid", "place"))
    a = F.shiftright("place", 20)
    many = blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    return (whole.select("uid", a.alias("a"), (a + F.expr("place & 1048575") - 1 + words).alias("b")),
            blocks.join(many, "gram").select("gram", "uid", "place", "n", "m"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, words: int = 0,
                   word_gram: int = WORD_GRAM) -> DataFrame:
    """(uid, a, b, of_words): byte spans, possibly overlapping, that repeat
    elsewhere, and with ``words`` spans of that many words that do."""
    texts = docs.select(_uid(F.col("doc_id").cast("long"), F.col("text")).alias("uid"), "text")
    found = stored(_instances(texts, length, gram), "anchors")
    blocks = found.groupBy("gram", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"), F.min_by("place", "uid").alias("place"))
    blocks = stored(blocks, "blocks")
    copied = blocks.where("n > 1").select("gram", "block")
    at = F.shiftright("place", 20)
    whole = found.join(copied, ["gram", "block"]).select(
        "uid", (at - F.expr("place & 1023")).alias("a"), (at - F.expr("shiftright(place, 10) & 1023") + length).alias("b"))
    many = stored(blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "grams")
    wanted = blocks.join(many, "gram").select("gram", "uid", "place", "n", "m", F.lit(False).alias("of_words"))
    if words:
        passages, more = _word_blocks(texts, words, word_gram)
        wanted = wanted.unionByName(more.withColumn("of_words", F.lit(True)))
    every = stored(_contents(texts, wanted, length, gram, words), "contents")
    content = every.where("not of_words")
    spans = whole.unionByName(_compared(content.where(F.col("m") <= hot), length, gram))
    busy = content.where(F.col("m") > hot)
    if not busy.isEmpty():
        spans = spans.unionByName(_hot_windows(busy, length))
    spans = spans.withColumn("of_words", F.lit(False))
    if not words:
        return spans
    content = every.where("of_words")
    passages = passages.unionByName(_compared_words(content.where(F.col("m") <= hot), words))
    busy = content.where(F.col("m") > hot)
    if not busy.isEmpty():
        passages = passages.unionByName(_hot_words(busy, words))
    return spans.unionByName(passages.withColumn("of_words", F.lit(True)))


def _merged(found) -> list[list[int]]:
    """Maximal runs of the spans."""
    runs: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in found or ()):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append(list(s))
    return runs


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, words: int = 0,
           word_gram: int = WORD_GRAM) -> DataFrame:
    """Per row: doc_id, ``spans`` (maximal removed byte runs) and ``kept`` (the
    remaining bytes, which may end within a character), n_bytes, and
    n_passage_words: words covered by ``words`` words that also start elsewhere."""
    spans = repeated_spans(docs, length, gram, hot, words, word_gram)
    span = F.struct("a", "b")
    lists = spans.groupBy("uid").agg(F.collect_list(F.when(~F.col("of_words"), span)).alias("found"),
                                     F.collect_list(F.when(F.col("of_words"), span)).alias("passages"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       _uid(F.col("doc_id").cast("long"), F.col("text")).alias("uid"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in T.sliced(batches):
            texts = T.as_bytes(batch.column(1))
            spans, kept = [], []
            for text, found in zip(texts, batch.column(2).to_pylist()):
                runs = _merged(found)
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                spans.append([{"a": a, "b": b} for a, b in runs])
            covered = [sum(b - a for a, b in _merged(found)) for found in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pairs), pa.array(kept, pa.binary()),
                 pa.array(covered, pa.int64())],
                ["doc_id", "n_bytes", "spans", "kept", "n_passage_words"])

    return (rows.join(lists, "uid", "left").select("doc_id", "text", "found", "passages")
            .mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<a:long,b:long>>, kept binary, n_passage_words long"))


@register("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from every whole document; ``text`` is
    what is left, with marks for the halves of cut characters.  n_passage_words
    counts the words of repeated passages of 50 words or more, removed or not."""
    return remove(table(spark, sf_dir, "documents"), words=WORDS).select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.expr("make_valid_utf8(cast(kept AS string))").alias("text"), "n_passage_words")
