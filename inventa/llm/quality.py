"""Quality classifier by importance resampling.

Two bag-of-hashed-n-gram models (word and symbol-run unigrams and bigrams in
``buckets`` buckets) are counted: one over labelled good texts (target), one
over all texts (raw).  A text's log importance weight is the mean over its
n-grams of ``log p_target - log p_raw``, for a text of ``STANDARD`` n-grams (a
plain sum lets the length decide where the labels are few).  With Gumbel noise
added, the k largest keys are kept: a draw without replacement in proportion to
the weights.  k is
the number of texts whose own weight reaches the cut that best separates the
labelled texts held out of the target model.

Labels are read as a bounded sample (``label_bound`` rows of smallest id hash);
both models' counts, all weights and the choice of the k-th key cover every row.

Defined cases: null and empty texts and texts of no token have weight 0 and are
never kept; equal texts have equal keys, so copies are kept or rejected
together (ties with the k-th key are kept); repeated rows give repeated rows;
an empty table gives none; without good labels nothing is known to be better
than the corpus, so everything with a token is kept.  Labels with a null id or
null quality are ignored; other columns of either table are never used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.llm.storage import stored
from inventa.session import table

BUCKETS = 1 << 16
LABEL_BOUND = 40_000
SMOOTHING = 1.0
STANDARD = 300
SYMBOL = ~(T.ALNUM | ~T.NON_SPACE)


def features(texts: list[bytes], buckets: int = BUCKETS):
    """(index of the text, bucket) arrays per chunk of ``texts``."""
    for lo, _, buf, starts in T.chunks(texts):
        low = T.LOWER[buf]
        a, b = T.word_spans(low, T.ALNUM), T.word_spans(low, SYMBOL)
        at = np.concatenate((a[0], b[0]))
        order = np.argsort(at, kind="stable")
        token = np.concatenate((T.span_hashes(low, *a), T.span_hashes(low, *b)))[order]
        doc = T.doc_of(at[order], starts)
        same = doc[1:] == doc[:-1]
        pair = T.ngram_hashes(token, 2)[same]
        hashed = np.concatenate((token, pair)) % np.uint64(buckets)
        yield lo + np.concatenate((doc, doc[1:][same])), hashed.astype(np.int64)


def _label_sample(labels: DataFrame, bound: int) -> dict[int, tuple[int, bool]]:
    """doc_id -> (1 for a good text else 0, in the target model's half)."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .select(F.col("doc_id").cast("long").alias("i"), good.cast("int").alias("g"),
                    F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
            .groupBy("i", "h").agg(F.min("g").alias("g")).orderBy("h", "i").limit(bound).collect())
    return {r["i"]: (r["g"], r["h"] % 2 == 0) for r in rows}


def _counts(docs: DataFrame, target: set[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all texts and over the target texts (partial sums per
    task, at most ``buckets`` rows each)."""

    def count(batches):
        import pyarrow as pa

        raw, tgt = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in T.sliced(batches):
            good = np.array([i in target for i in batch.column(0).to_pylist()], dtype=bool)
            for doc, bucket in features(T.as_bytes(batch.column(1)), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                tgt += np.bincount(bucket[good[doc]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(tgt[used])], ["b", "raw", "tgt"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "b long, raw long, tgt long")
    raw, tgt = np.zeros(buckets), np.zeros(buckets)
    for r in parts.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("tgt").alias("tgt")).collect():
        raw[r["b"]], tgt[r["b"]] = r["raw"], r["tgt"]
    return raw, tgt


def _scored(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """The rows with ``n_features``, ``log_weight``, the perturbed ``key`` and
    ``key_order``, an integer in the order of the keys."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        import hashlib

        import pyarrow as pa

        for batch in T.sliced(batches):
            texts = T.as_bytes(batch.column(names.index("text")))
            size, weight = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            for doc, bucket in features(texts, len(shared.value)):
                size += np.bincount(doc, minlength=len(texts))
                weight += np.bincount(doc, weights=shared.value[bucket], minlength=len(texts))
            weight *= STANDARD / np.maximum(size, 1)
            draw = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=6, key=b"%d" % seed).digest(), "big")
                             for t in texts], dtype=np.float64)
            key = weight - np.log(-np.log((draw + 0.5) / 2.0**48)) + 0.0
            bits = key.view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size), pa.array(weight), pa.array(key), pa.array(order)],
                [*names, "n_features", "log_weight", "key", "key_order"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{schema}, n_features long, log_weight double, key double, key_order long")


def _best_cut(good: np.ndarray, bad: np.ndarray, most_lost: float) -> float:
    """Weight that separates best, losing at most that share of the good."""
    if not len(good):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    limit = good[int(most_lost * len(good))]
    cuts = np.unique(np.concatenate(([limit], good[good <= limit], bad[bad <= limit])))
    gain = np.searchsorted(bad, cuts) / max(1, len(bad)) - np.searchsorted(good, cuts) / len(good)
    return float(cuts[int(np.argmax(gain))])


def _kth_largest(order: DataFrame, k: int) -> int:
    """Exact k-th largest ``key_order`` by radix selection: four counting
    passes of 16 bits, each giving at most 65,536 rows."""
    found, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key_order", 48) if shift == 48 else F.shiftrightunsigned("key_order", shift).bitwiseAND(0xFFFF)
        rows = order if shift == 48 else order.where(F.shiftright("key_order", shift + 16) == found)
        count = {r["d"]: r["n"] for r in rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(count, reverse=True):
            if count[d] >= left:
                break
            left -= count[d]
        found = found * 65536 + d
    return found


def fit(docs: DataFrame, sample: dict[int, tuple[int, bool]], buckets: int = BUCKETS,
        smoothing: float = SMOOTHING) -> np.ndarray | None:
    """Log ratio per bucket of the target and raw models (None: no target)."""
    raw, tgt = _counts(docs, {i for i, (good, half) in sample.items() if good and half}, buckets)
    if not tgt.any():
        return None
    return (np.log((tgt + smoothing) / (tgt.sum() + smoothing * buckets))
            - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets)))


def _draw(docs: DataFrame, labels: DataFrame, buckets: int, label_bound: int, smoothing: float, most_lost: float,
          seed: int) -> tuple[np.ndarray, DataFrame, int]:
    """(log ratios, stored weights of every row, least kept ``key_order``)."""
    spark = docs.sparkSession
    sample = _label_sample(labels, label_bound)
    ratio = fit(docs, sample, buckets, smoothing)
    known = ratio is not None
    ratio = ratio if known else np.zeros(buckets)
    scored = stored(_scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratio, seed).drop("text"),
                    "quality")
    some = scored.where("n_features > 0")
    cut = -np.inf
    if known:
        held = spark.createDataFrame([(i, g) for i, (g, half) in sample.items() if not (g and half)],
                                     "doc_id long, good int")
        rows = some.join(F.broadcast(held), "doc_id").select("good", "log_weight").collect()
        good, weight = np.array([r[0] for r in rows], dtype=int), np.array([r[1] for r in rows])
        cut = _best_cut(weight[good == 1], weight[good == 0], most_lost)
    k = some.where(F.col("log_weight") >= F.lit(float(cut))).count()
    return ratio, scored, _kth_largest(some.select("key_order"), k) if k else 2**63 - 1


def classify(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_bound: int = LABEL_BOUND,
             smoothing: float = SMOOTHING, most_lost: float = 0.01, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, log_weight, key and kept."""
    _, scored, least = _draw(docs, labels, buckets, label_bound, smoothing, most_lost, seed)
    kept = (F.col("n_features") > 0) & (F.col("key_order") >= F.lit(least))
    return scored.select("doc_id", "n_features", "log_weight", "key", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_bound: int = LABEL_BOUND,
             smoothing: float = SMOOTHING, most_lost: float = 0.01, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    ratio, _, least = _draw(docs, labels, buckets, label_bound, smoothing, most_lost, seed)
    text = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = _scored(text, ratio, seed).where((F.col("n_features") > 0) & (F.col("key_order") >= F.lit(least)))
    return kept.select("row.*")


@register("op1_importance_resampling")
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and decisions for every row of documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
