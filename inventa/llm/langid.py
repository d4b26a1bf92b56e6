"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (1 to 4 bytes; A-Z
lower-cased, other ASCII taken as blanks), scaled to length 1.  Document
frequencies come from every training row.  Each language's vectors are grouped
into a few centroids by spherical k-means on a bounded sample (``sample_size``
distinct texts of smallest hash per language).  A text gets the language of the
centroid of largest cosine; it is *rejected* where that cosine is below the
centroid's own limit, learned from the distances of the sampled texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a rejected text keeps its nearest language in ``nearest`` and is ``und`` in
``lang_pred`` of :func:`identify`; rows without a language are not learned from;
rows that repeat an id and text are sampled once; repeated rows and copies get equal answers; without training rows all is
``und``; an empty table gives no rows; no column but ``text`` is used to predict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.session import table

BUCKETS = 1 << 13
SIZES = (1, 2, 3, 4)
SAMPLE_SIZE = 400
CENTROIDS = 4
_FOLD = T.LOWER.copy()
_FOLD[~T.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray


def counts(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    out = np.zeros((len(texts), buckets), dtype=np.float32)
    for lo, hi, buf, starts in T.chunks(texts):
        low = _FOLD[buf].astype(np.uint64)
        doc = np.repeat(np.arange(hi - lo), np.diff(starts))
        gram = np.zeros(len(low), dtype=np.uint64)
        cells = np.zeros((hi - lo) * buckets, dtype=np.int64)
        for n in range(1, max(SIZES) + 1):
            m = len(low) - n + 1
            if m <= 0:
                break
            gram = (gram[:m] << np.uint64(8)) | low[n - 1:n - 1 + m]
            if n in SIZES:
                inside = doc[:m] == doc[n - 1:]
                cell = T.mix(gram + np.uint64(n << 40)) % np.uint64(buckets)
                cells += np.bincount((doc[:m] * buckets + cell.astype(np.int64))[inside], minlength=len(cells))
        out[lo:hi] = cells.reshape(hi - lo, buckets)
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (zero rows stay zero)."""
    tf = np.log1p(counts(texts, len(idf))) * idf
    return tf / np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)


def _has_letter(texts) -> np.ndarray:
    import re

    letter = re.compile(r"[^\W\d_]")
    return np.array([t is not None and letter.search(t) is not None for t in texts], dtype=bool)


def _document_frequencies(train: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    def count(batches):
        import pyarrow as pa

        total, seen = 0, np.zeros(buckets, dtype=np.int64)
        for batch in T.sliced(batches, 256):
            seen += (counts(T.as_bytes(batch.column(0)), buckets) > 0).sum(axis=0)
            total += batch.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(seen[used], total))], ["b", "n"])

    df, total = np.zeros(buckets), 0
    for r in train.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        if r["b"] < 0:
            total = r["n"]
        else:
            df[r["b"]] = r["n"]
    return df, total


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts: (centroids, group)."""
    starts = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts]
    for _ in range(rounds):
        group = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[group == g].sum(axis=0) if (group == g).any() else c[g] for g in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, np.argmax(x @ c.T, axis=1)


def fit(train: DataFrame, buckets: int = BUCKETS, sample_size: int = SAMPLE_SIZE, centroids: int = CENTROIDS,
        slack: float = 0.5) -> Model:
    """Learn from the rows of ``train`` (doc_id, text, lang).  A centroid's
    limit is ``slack`` times the first percentile of its texts' cosines."""
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, total = _document_frequencies(known, buckets)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # a language's rows are thinned by hash and made distinct before they are
    # ranked, so that neither a common language nor a repeated row meets in one task
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    thin = F.pmod(F.col("h"), F.lit(1 << 30)) < (1 << 30) * (4.0 * sample_size) / F.col("size")
    first = Window.partitionBy("lang").orderBy("h", "text")
    chosen = (known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(sizes), "lang").where(thin)
              .groupBy("lang", "h").agg(F.min("text").alias("text"))
              .withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_size).select("lang", "text"))
    shared = train.sparkSession.sparkContext.broadcast(idf)

    def vector(batches):
        import pyarrow as pa

        for batch in T.sliced(batches, 64):
            x = vectors(T.as_bytes(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["lang", "x"])

    def centres(group):
        import pyarrow as pa

        x = np.stack([np.asarray(v, dtype=np.float32) for v in group.column("x").to_pylist()])
        x = x[np.lexsort(x.T[:8])]
        c, own = cluster(x, centroids)
        near = (x * c[own]).sum(axis=1)
        limit = [slack * float(np.quantile(near[own == g], 0.01)) if (own == g).any() else 0.0 for g in range(len(c))]
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(c), "limit": limit,
                         "c": pa.array(list(c), pa.list_(pa.float32()))})

    rows = (chosen.mapInArrow(vector, "lang string, x array<float>")
            .groupBy("lang").applyInArrow(centres, "lang string, limit double, c array<float>")
            .orderBy("lang", "c").collect())
    return Model([r["lang"] for r in rows], idf,
                 np.array([r["c"] for r in rows], dtype=np.float32).reshape(len(rows), buckets),
                 np.array([r["limit"] for r in rows]))


def nearest(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with ``nearest`` (a learned language or ``und``), ``score``
    (cosine, 0 to 1) and ``rejected``."""
    names = docs.columns
    # plain values: a class of this package could not be read by a worker without it
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.centroids, model.limits))

    def predict(batches):
        import pyarrow as pa

        m = Model(*shared.value)
        for batch in T.sliced(batches, 256):
            column = batch.column(names.index("text"))
            lettered = _has_letter(column.to_pylist())
            lang, score, far = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
            if len(m.languages):
                near = vectors(T.as_bytes(column), m.idf) @ m.centroids.T
                best = np.argmax(near, axis=1)
                top = near[np.arange(len(best)), best].astype(float)
                lang = [m.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                score = np.where(lettered, np.clip(top, 0, 1), 0.0)
                far = ~lettered | (top < m.limits[best])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang), pa.array(score), pa.array(far)], [*names, "nearest", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{schema}, nearest string, score double, rejected boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred (``und`` where rejected), nearest, score, rejected."""
    return (nearest(docs.select("doc_id", "text"), model)
            .select("doc_id", F.when(F.col("rejected"), "und").otherwise(F.col("nearest")).alias("lang_pred"),
                    "nearest", "score", "rejected"))


def held_out() -> Column:
    """Documents kept from training: crc32 of the id's text modulo 4 is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest learned language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")
