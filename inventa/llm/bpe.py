"""Byte-level BPE encoding and decoding, by DuckDB queries inside the tasks.

A text is split by the tokenizer's pattern, whose matches begin where the kinds
of neighbouring characters say (by the regex module for any other pattern); the
distinct pieces of a slice of texts become token-position rows (piece, position,
token), one per byte.  A recursive query joins neighbouring tokens to the merge
table and contracts each piece's leftmost pair of least rank, round by round,
until no piece has a pair left.  Decoding joins the ids to the vocabulary and
reads the bytes in order of position, a block of positions at a time.  A worker
process keeps the pieces it has encoded, up to a bounded number, and one
in-memory database of bounded size that has no folder to spill to: a query's
pieces are bounded by the rows of all their rounds together.  A slice's
pieces are looked up once each, not once per occurrence.

A piece of over ``LONG_PIECE`` bytes (a run of thousands of letters or blanks)
would need as many rounds as it has merges, each over its whole row set; it goes
through the same contraction with a heap of pairs instead, one piece at a time.
So does every piece in a worker whose Python has no DuckDB; ids are then decoded
by position in the vocabulary.  Both give the same ids and bytes.

Defined cases: null text is empty and has no tokens; null ids decode to the
empty string; an id outside the vocabulary is an error; ids that are not valid
UTF-8 decode with replacement marks in :func:`decode` (never after
:func:`encode`); repeated rows are treated alike; empty tables give no rows;
other columns, whatever their names, are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import types
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG_PIECE = 192
CACHED_PIECES = 600_000
ROUND_ROWS = 3_000_000
# the pattern whose matches are found by the kinds of neighbouring characters;
# any other goes through the regex module
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DECODE_ROWS = 1 << 20
SLICE_CHARS = 1 << 19
MEMORY = "250MB"

# a found pair is one number (new token, its position, the position that goes,
# the next position), so the least of a piece's numbers is its whole contraction;
# positions fit in 8 bits (LONG_PIECE)
_ENCODE = """
WITH RECURSIVE step(w, pos, nxt, id, n) AS (
  SELECT w, pos, nxt, id, 0 FROM bytes_of_pieces
  UNION ALL
  (WITH best AS (
     SELECT a.w AS w, min((m.id::BIGINT << 24) + (a.pos << 16) + (b.pos << 8) + b.nxt) AS k
     FROM step a JOIN step b ON a.w = b.w AND a.nxt = b.pos JOIN merges m ON m.a = a.id AND m.b = b.id
     GROUP BY a.w)
   SELECT s.w, s.pos, CASE WHEN s.pos = ((k >> 16) & 255) THEN (k & 255)::INTEGER ELSE s.nxt END,
          CASE WHEN s.pos = ((k >> 16) & 255) THEN (k >> 24)::INTEGER ELSE s.id END, s.n + 1
   FROM step s JOIN best ON s.w = best.w WHERE s.pos <> ((k >> 8) & 255)))
SELECT w, pos, id, n FROM step
"""

_DECODE = "SELECT v.bytes FROM tokens JOIN vocabulary v USING (id) ORDER BY pos"


def read_ranks(path: str) -> list[bytes]:
    """The token bytes of a rank file, in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _kinds() -> np.ndarray:
    """Per code point: 0 blank, 1 letter, 2 number, 3 other, as the regex module has them."""
    import regex

    kind = np.full(0x110000, 3, dtype=np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for k, own in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(own, every):
            kind[ord(m[0][0]):ord(m[0][-1]) + 1] = k
    return kind


def _match_starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a match of PLAIN begins at each character; ``first`` marks the
    first character of each text."""
    n = len(code)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # before a character that is not blank: a run of blanks leaves its last one, which goes along if it is a space
    goes_on = (kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:]
    start[:-1] |= goes_on
    start[1:] &= ~(goes_on & (code[:-1] == 32))
    # 's 't 'm 'd 're 've 'll, where a match begins at the apostrophe
    at = np.flatnonzero(start & (code == 39))
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    c1, c2 = code[at + 1], np.where(at + 2 < n, code[np.minimum(at + 2, n - 1)], 0)
    c2 = np.where(first[np.minimum(at + 2, n - 1)], 0, c2)
    one = np.isin(c1, [ord(c) for c in "stmd"])
    two = (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
    for some, size in ((at[one], 2), (at[two], 3)):
        for k in range(1, size):
            start[some + k] = False
        start[(some + size)[some + size < n]] = True
    return start


def _joined(values, cut: np.ndarray) -> list[bytes]:
    """The bytes of an Arrow column of bytes, joined from each cut to the next."""
    chunks = [c for c in (values.chunks if hasattr(values, "chunks") else [values]) if len(c)]
    at, data = [np.zeros(1, dtype=np.int64)], []
    for c in chunks:
        offsets = np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset:c.offset + len(c) + 1]
        at.append(at[-1][-1] + offsets[1:] - offsets[0])
        data.append(memoryview(c.buffers()[2] or b"")[offsets[0]:offsets[-1]])
    whole = b"".join(data)
    ends = np.concatenate(at)[cut].tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], pattern: str, text: bool = False):
        import pyarrow as pa
        import regex

        try:
            import duckdb
        except ModuleNotFoundError:
            duckdb = None
        self.pattern, self.text = regex.compile(pattern), text
        self.kinds = _kinds() if pattern == PLAIN else None
        # piece -> ids; the older half goes when the newer one is full
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.decimal = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb and duckdb.connect(":memory:")
        if self.db is None:
            return
        self.db.execute(f"SET threads TO 1; SET memory_limit = '{MEMORY}'; SET temp_directory = ''")
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t))
                 if t[:k] in self.rank and t[k:] in self.rank]
        self._load("merges", np.array(pairs, dtype=np.int32).reshape(-1, 3), ("a", "b", "id"))
        own = pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "bytes": pa.array(tokens, pa.binary())})
        self.db.register("own", own)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM own")
        self.db.unregister("own")

    def _load(self, name: str, rows: np.ndarray, columns: tuple[str, ...]) -> None:
        import pyarrow as pa

        self.db.register("incoming", pa.table({c: rows[:, k] for k, c in enumerate(columns)}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, piece: bytes) -> list[int]:
        """A single long piece: the same contraction, with a heap of pairs."""
        ids = [int(self.of_byte[b]) for b in piece]
        size = len(ids)
        nxt, prev, token = list(range(1, size + 1)), list(range(-1, size - 1)), [piece[i:i + 1] for i in range(size)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < size and (r := self.rank.get(token[i] + token[nxt[i]])) is not None:
                heap.append((r, i, token[i], token[nxt[i]])) if building else heapq.heappush(heap, (r, i, token[i], token[nxt[i]]))

        building = True
        for i in range(size):
            offer(i)
        building = False
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = nxt[i]
            if token[i] != left or j >= size or token[j] != right:
                continue
            ids[i], token[i], token[j], nxt[i] = r, left + right, b"", nxt[j]
            if nxt[j] < size:
                prev[nxt[j]] = i
            offer(i)
            offer(prev[i])
        return [ids[i] for i in range(size) if token[i]]

    def _contracted(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one query: their ids, one after the other, and where each begins."""
        size = np.array([len(b) for b in raw], dtype=np.int32)
        w = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        pos = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
        ids = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        self._load("bytes_of_pieces", np.stack((w, pos, pos + 1, ids), axis=1), ("w", "pos", "nxt", "id"))
        found = self.db.sql(_ENCODE).to_arrow_table()
        out = {c: found.column(c).to_numpy() for c in found.column_names}
        # a piece's last round holds its tokens
        last = np.zeros(len(raw), dtype=out["n"].dtype)
        np.maximum.at(last, out["w"], out["n"])
        kept = np.flatnonzero(out["n"] == last[out["w"]])
        w = out["w"][kept]
        by = np.argsort((w.astype(np.int64) << 8) + out["pos"][kept], kind="stable")
        return out["id"][kept][by].astype(np.int32), np.searchsorted(w[by], np.arange(len(raw) + 1))

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that are not known yet."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        short = (size <= LONG_PIECE) & (self.db is not None)
        # rows of all rounds: at most half the square of a piece's length
        most = np.cumsum(np.where(short, size * (size + 1) // 2, 0))
        for part in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(most // ROUND_ROWS)) + 1):
            some = [pieces[i] for i in part[short[part]].tolist()]
            if some:
                ids, cut = self._contracted(some)
                ids, cut = ids.tobytes(), (cut * ids.itemsize).tolist()
                self.known.update((p, ids[a:b]) for p, a, b in zip(some, cut, cut[1:]))
            for i in part[~short[part]].tolist():
                self.known[pieces[i]] = np.array(self._contract(pieces[i]), dtype=np.int32).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if 2 * len(self.known) > CACHED_PIECES:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, pieces))
        new = [p for p, ids in zip(pieces, found) if ids is None]
        if not new:
            return found
        back = [p for p in new if p in self.older]
        self.known.update((p, self.older[p]) for p in back)
        if len(back) < len(new):
            self._learn([p for p in new if p not in self.older])
        return [self.known[p] if ids is None else ids for p, ids in zip(pieces, found)]

    def _split(self, texts: list[str]):
        """The pieces of the texts as an Arrow column of bytes, and where each
        text begins in it."""
        import pyarrow as pa

        if self.kinds is None:
            split = [self.pattern.findall(t) for t in texts]
            pieces = pa.array(list(chain.from_iterable(split)), pa.large_string())
            return pieces.cast(pa.large_binary()), np.cumsum([0, *map(len, split)])
        begin = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(code) + 1, dtype=bool)
        first[begin] = True
        at = np.flatnonzero(_match_starts(code, self.kinds[code], first[:-1])) if whole else np.zeros(0, dtype=np.int64)
        cut = np.searchsorted(at, begin)
        raw = whole.encode()
        if len(raw) > len(code):
            at = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)[at]
        offsets = np.append(at, len(raw))
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), cut

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """Per text: its ids, and (for a codec with ``text``) them as decimals
        joined by one space."""
        import pyarrow as pa

        pieces, ends = self._split(texts)
        pieces = pieces.dictionary_encode()
        known = self._ids(_joined(pieces.dictionary, np.arange(len(pieces.dictionary) + 1)))
        pool = np.frombuffer(b"".join(known), dtype=np.int32)
        begin = np.cumsum([0, *map(len, known)]) // pool.itemsize
        of = pieces.indices.to_numpy()
        cut = np.concatenate(([0], np.cumsum(np.diff(begin)[of])))[ends]
        ids = pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), pa.array(pool)).take(pieces.indices).flatten()
        row = ids.to_numpy()
        rows = [row[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]
        if not self.text:
            return [(r, b"") for r in rows]
        return [(r, d[:-1]) for r, d in zip(rows, _joined(self.decimal.take(ids), cut))]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id sequence, by a join in order of position."""
        import pyarrow as pa

        cut = np.cumsum([0, *map(len, rows)])
        if not cut[-1]:
            return [b""] * len(rows)
        ids = np.concatenate(rows)
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("token id outside the vocabulary")
        if self.db is None:
            return _joined(pa.array(self.tokens, pa.large_binary()).take(pa.array(ids)), cut)
        found = []
        for lo in range(0, len(ids), DECODE_ROWS):
            block = ids[lo:lo + DECODE_ROWS]
            self._load("tokens", np.stack((np.arange(len(block)), block), axis=1).astype(np.int32), ("pos", "id"))
            found.extend(self.db.sql(_DECODE).to_arrow_table().column(0).cast(pa.large_binary()).chunks)
        return _joined(pa.chunked_array(found, pa.large_binary()), cut)


def _codec(key: tuple, make) -> Codec:
    """The codec of this worker process: later tasks find it again, with the
    pieces it knows."""
    kept = sys.modules.setdefault("_kept_codec", types.ModuleType("_kept_codec"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.codec = key, make()
    return kept.codec


def _vocabulary(path: str | None, pattern: str | None) -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN


def _slices(texts: list[str], most: int = SLICE_CHARS):
    """(first, last) of runs of texts of about ``most`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _mapped(rows: DataFrame, column: str, fields: list[tuple[str, str]], make, path: str | None, pattern: str | None,
            text: bool = False) -> DataFrame:
    """The rows with the columns that ``make(codec, values)`` gives."""
    shared = rows.sparkSession.sparkContext.broadcast(_vocabulary(path, pattern))
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        codec = _codec((path, pattern, text), lambda: Codec(*shared.value, text))
        for batch in batches:
            values = batch.column(names.index(column)).to_pylist()
            for lo, hi in _slices([v or "" for v in values]):
                made = make(codec, values[lo:hi])
                more = [pa.array([r[k] for r in made], arrow[kind]) for k, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *more],
                                                 [*names, *(f[0] for f in fields)])
            # a worker that stays for other tasks keeps no slice's memory
            pa.default_memory_pool().release_unused()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, ", ".join([schema, *(f"{n} {k}" for n, k in fields)]))


def _kept(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{column}`").alias("value"))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with ``ids`` (array of int) and ``n_tokens``."""
    def make(codec, texts):
        return [(ids, len(ids)) for ids, _ in codec.encode([t or "" for t in texts])]

    out = _mapped(_kept(docs, text), "value", [("ids", "array<int>"), ("n_tokens", "long")], make, path, pattern)
    return out.select("row.*", "ids", "n_tokens")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of the column of ids."""
    def make(codec, values):
        return [(b.decode(errors="replace"),) for b in codec.decode([np.array(v or [], dtype=np.int64) for v in values])]

    return _mapped(_kept(rows, ids), "value", [("decoded", "string")], make, path, pattern).select("row.*", "decoded")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, from encoding and
    decoding again in the same task."""
    def make(codec, texts):
        coded = codec.encode([t or "" for t in texts])
        back = codec.decode([ids for ids, _ in coded])
        return [(len(ids), hashlib.sha256(s).hexdigest(), hashlib.sha256(b).hexdigest()) for (ids, s), b in zip(coded, back)]

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return _mapped(docs.select("doc_id", "text"), "text", fields, make, path, pattern, True).drop("text")


@register("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every whole document, encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"))
