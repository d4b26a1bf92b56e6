"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of ``ORDER`` bytes (letters lower-cased, each
run of other ASCII taken as one blank) are learned from the labelled texts: one
toxic, one ordinary.  The highest order discounts raw counts, the lower ones the
counts of distinct preceding bytes of their class; the lowest ``SHARED`` orders
are *shared*: their counts come from every text of the corpus, labelled or not,
so an expression that one class never shows still has a probability there, and
the same one in both.  A text's evidence is the difference of its two
log-likelihoods, taken per passage (``PASSAGE`` bytes, every half passage) and
normalised by the passage's length; the strongest passage decides, so that a long
text does not dilute it.  The cut is the one that best separates labelled texts
held out of both models, with a clean text lost counting ``CLEAN`` times a toxic
one found; the score is a logistic of the distance to the cut.

The models are tables of n-grams, built by grouped counts and joins.  Scoring
needs one number per n-gram.  Tables of up to ``slice_bytes`` are broadcast;
larger ones go in slices by n-gram, one pass over the texts each, and the
passages' partial sums are added up.

Defined cases: null and empty texts have no evidence (0 before the logistic);
texts without a letter are scored by their blanks; labels with a null id or
class are ignored, and of contradicting labels of one document the toxic one
counts; a null doc_id is learned from by no class and is ``held_out``; repeated
rows and equal texts have equal scores; without labels of both classes every
score is 0; an empty table gives no rows; other columns of either table are
never used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.llm.storage import stored
from inventa.session import table

ORDER = 5
SHARED = 1
PASSAGE = 100
CLEAN = 4.0
SLICE_BYTES = 64 << 20
GRAM_BYTES = 12
LABEL_ROWS = 2_000_000
HELD = 2_000_000
CUT_ROWS = 200_000
_FOLD = T.LOWER.copy()
_FOLD[~T.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 32


def grams(texts: list[bytes], order: int = ORDER):
    """(first text, last text, text of each n-gram, n-gram) per chunk: one
    n-gram per folded byte, ending there, and one that ends in the end mark.
    Bytes before the text are 0, and so is the end mark."""
    for lo, hi, buf, starts in T.chunks(texts):
        low = _FOLD[buf]
        low[starts[1:] - 1] = 0
        low = low[~((low == 32) & np.concatenate(([False], low[:-1] == 32)))]
        pad = np.zeros(order - 1, dtype=np.uint8)
        low = np.concatenate((pad, np.repeat(low, np.where(low == 0, order - 1, 1))))
        gram = np.zeros(len(low) - order + 1, dtype=np.uint64)
        for k in range(order):
            gram = (gram << np.uint64(8)) | low[k:k + len(gram)]
        last, before = low[order - 1:], low[order - 2:-1]
        ends = np.flatnonzero(last == 0)[order - 2::order - 1] + 1
        own = np.repeat(np.arange(hi - lo), np.diff(ends, prepend=0))
        used = np.flatnonzero((last != 0) | (before != 0))
        yield lo, hi, lo + own[used], gram[used]


def _count(docs: DataFrame, order: int) -> DataFrame:
    """(g, c0, c1) of every n-gram of the corpus: its counts in the texts with
    ``class`` 0 and 1 (0 for n-grams of other texts only)."""
    def count(batches):
        import pyarrow as pa

        def rows(keys, n):
            kind = (keys & np.uint64(3)).astype(np.int64)
            g = (keys >> np.uint64(2)).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(np.where(kind == 0, n, 0)), pa.array(np.where(kind == 1, n, 0))], ["g", "c0", "c1"])

        held, size = [], 0
        for batch in T.sliced(batches):
            kind = np.array([2 if k is None else k for k in batch.column(1).to_pylist()], dtype=np.uint64)
            for _, _, doc, gram in grams(T.as_bytes(batch.column(0)), order):
                held.append(np.unique((gram << np.uint64(2)) | kind[doc], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*_merged(held))

    parts = docs.select("text", "class").mapInArrow(count, "g long, c0 long, c1 long")
    return parts.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _suffix(n: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _level(rows: DataFrame, lower: DataFrame | None, n: int, classes: list[str]) -> DataFrame:
    """(g, p0, p1) of the n-grams: discounted counts ``classes`` (one shared, or
    one per class) over those of the context, interpolated with order n - 1.
    A context has at most 257 continuations, so its window stays small."""
    by = Window.partitionBy("ctx")
    rows = rows.withColumn("ctx", F.shiftright("g", 8))
    once = rows.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in classes for k in (1, 2)]).first()
    base = rows if lower is None else rows.withColumn("low", _suffix(n - 1)).join(
        lower.select(F.col("g").alias("low"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "low")
    out = base.select("*", *[F.sum(c).over(by).alias(f"{c}_all") for c in classes],
                      *[F.count(F.when(F.col(c) > 0, 1)).over(by).alias(f"{c}_types") for c in classes])
    probs = []
    for k in (0, 1):
        c = classes[min(k, len(classes) - 1)]
        n1, n2 = once[f"{c}_1"], once[f"{c}_2"]
        d = F.lit(n1 / (n1 + 2 * n2) if n1 else 0.5)
        low = F.lit(1 / 257) if lower is None else F.col(f"q{k}")
        seen = (F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"{c}_types") * low) / F.col(f"{c}_all")
        probs.append(F.when(F.col(f"{c}_all") > 0, seen).otherwise(low).alias(f"p{k}"))
    return out.select("g", *probs)


def fit(docs: DataFrame, order: int = ORDER, shared: int = SHARED) -> DataFrame:
    """(g, delta): log of the toxic over the ordinary probability of the last
    byte of each n-gram of the corpus.  ``docs`` has ``text`` and ``class`` (0,
    1 or null)."""
    tables = {order: stored(_count(docs, order).withColumn("c", F.lit(1)), "kn")}
    for n in range(order - 1, 0, -1):
        some = tables[n + 1].groupBy(_suffix(n).alias("g")).agg(
            F.count(F.when(F.col("c0") > 0, 1)).alias("c0"), F.count(F.when(F.col("c1") > 0, 1)).alias("c1"),
            F.count(F.lit(1)).alias("c"))
        tables[n] = stored(some, "kn")
    model = None
    for n in range(1, order + 1):
        model = stored(_level(tables[n], model, n, ["c"] if n <= shared else ["c0", "c1"]), "kn_model")
    return model.select("g", F.log(F.col("p1") / F.col("p0")).cast("float").alias("delta"))


def _halves(texts: list[bytes], keys: np.ndarray, delta: np.ndarray, order: int, half: int):
    """Per text: sums of ``delta`` over its half passages (n-grams that are not
    among the keys add nothing)."""
    out: list[np.ndarray] = [np.zeros(0)] * len(texts)
    for lo, hi, doc, gram in grams(texts, order):
        if not len(gram):
            continue
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        value = np.where(keys[at] == gram, delta[at], 0.0)
        size = np.bincount(doc - lo, minlength=hi - lo)
        blocks = -(-size // half)
        first = np.cumsum(blocks) - blocks
        inside = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
        total = np.bincount(first[doc - lo] + inside // half, value, minlength=int(blocks.sum()))
        for i in np.flatnonzero(size).tolist():
            out[lo + i] = total[first[i]:first[i] + blocks[i]]
    return out


def strongest(halves: np.ndarray, passage: int = PASSAGE) -> float:
    """Largest length-normalised evidence of a passage (two half passages)."""
    if not len(halves):
        return 0.0
    pairs = halves.copy()
    pairs[:-1] += halves[1:]
    return float(pairs.max() / passage)


def _read(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = part.toArrow()
    g, d = rows.column("g").to_numpy(), rows.column("delta").to_numpy()
    by = np.argsort(g)
    return g[by].astype(np.uint64), d[by]


def evidence(docs: DataFrame, model: DataFrame, order: int = ORDER, passage: int = PASSAGE,
             slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``evidence``, the strongest passage's difference
    of log-likelihoods per byte, in place of ``text``."""
    spark = docs.sparkSession
    slices = max(1, -(-model.count() * GRAM_BYTES // slice_bytes))
    names = [c for c in docs.columns if c != "text"]
    at, half = docs.columns.index("text"), passage // 2

    def score(held):
        def run(batches):
            import pyarrow as pa

            for batch in T.sliced(batches):
                found = _halves(T.as_bytes(batch.column(at)), *held.value, order, half)
                rest = [batch.column(k) for k in range(batch.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([strongest(h, passage) for h in found], pa.float64())],
                                                 [*names, "evidence"])
        return run

    def sums(held):
        def run(batches):
            import pyarrow as pa

            for batch in T.sliced(batches):
                found = _halves(T.as_bytes(batch.column(2)), *held.value, order, half)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))],
                                                 ["k1", "k2", "halves"])
        return run

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    if slices == 1:
        held = spark.sparkContext.broadcast(_read(model))
        return docs.mapInArrow(score(held), f"{schema}, evidence double")
    # equal texts have equal sums, so the texts are told apart by their digest alone
    digest = F.md5(F.coalesce("text", F.lit("")))
    key = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"k{k + 1}") for k in (0, 1)]
    parts = None
    for s in range(slices):
        held = spark.sparkContext.broadcast(_read(model.where(F.pmod(F.xxhash64("g"), F.lit(slices)) == s)))
        part = docs.select(*key, "text").mapInArrow(sums(held), "k1 long, k2 long, halves array<double>")
        part = stored(part.groupBy("k1", "k2").agg(F.any_value("halves").alias("halves")), "passages")
        held.destroy()
        parts = part if parts is None else parts.unionByName(part)
    added = F.aggregate(F.slice("all", 2, slices), F.col("all")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("h")), lambda i: F.element_at("h", i)
                                   + F.coalesce(F.try_element_at("h", i + 1), F.lit(0.0))))
    total = parts.groupBy("k1", "k2").agg(F.collect_list("halves").alias("all")).select(
        "k1", "k2", added.alias("h")).select(
        "k1", "k2", F.when(F.size("h") > 0, best / passage).otherwise(0.0).alias("evidence"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *key)
    return rows.join(total, ["k1", "k2"]).select(*[F.col(f"`{c}`") for c in names], "evidence")


def best_cut(checked: DataFrame, weight: float = CLEAN, rows_per_part: int = CUT_ROWS) -> tuple[float, float] | None:
    """Middle of the widest-apart neighbours at the cut with the largest share of
    toxic above it less ``weight`` times the share of clean (the least of equals),
    and the deviation of the clean ones; None if a class is missing.

    ``checked`` has ``check`` (0, 1) and ``evidence``; every row counts.  Rows of
    equal evidence are added up first; the rest is dealt into ranges of about
    ``rows_per_part`` values, whose totals give each range its running sums."""
    per = stored(checked.where(F.col("check").isNotNull()).groupBy("evidence").agg(
        F.count_if(F.col("check") == 1).alias("t"), F.count_if(F.col("check") == 0).alias("c")), "cut")
    x = F.col("evidence")
    total = per.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.min(x).alias("low")).first()
    if not total["t"] or not total["c"]:
        return None
    parts = -(-total["n"] // rows_per_part)
    edges = sorted(set(per.approxQuantile("evidence", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<double>"), lambda e: e < x))
    ranged = per.withColumn("part", part)
    before, t, c = [], 0, 0
    for r in ranged.groupBy("part").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).orderBy("part").collect():
        before.append((r["part"], t, c))
        t, c = t + r["t"], c + r["c"]
    upto = Window.partitionBy("part").orderBy("evidence").rowsBetween(Window.unboundedPreceding, 0)
    start = per.sparkSession.createDataFrame(before, "part int, t0 long, c0 long")
    sums = ranged.join(F.broadcast(start), "part").select(
        x, (F.col("t0") + F.sum("t").over(upto)).alias("below_t"), (F.col("c0") + F.sum("c").over(upto)).alias("below_c"))
    gain = (1 - F.col("below_t") / total["t"]) - weight * (1 - F.col("below_c") / total["c"])
    best = sums.agg(F.max(F.struct(gain.alias("gain"), (-x).alias("at"))).alias("b")).first()["b"]
    if 1 - weight >= best["gain"]:
        cut = total["low"] - 1e-6
    else:
        at = -best["at"]
        above = per.where(x > F.lit(at)).agg(F.min(x)).first()[0]
        cut = at + 1e-6 if above is None else (at + above) / 2
    mean = per.agg((F.sum(x * F.col("c")) / total["c"]).alias("m")).first()["m"]
    spread = per.agg((F.sum(F.pow(x - F.lit(mean), 2) * F.col("c")) / total["c"]).alias("v")).first()["v"]
    return cut, float(f"{spread ** 0.5:.14g}")  # sums of doubles differ in their last digits from run to run


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, shared: int = SHARED, passage: int = PASSAGE,
             clean: float = CLEAN, held_out: Column | None = None, calibration: int = 5,
             label_rows: int = LABEL_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, evidence.

    ``held_out`` marks rows whose labels are not learned from.  One labelled
    document in ``calibration`` (by id hash) is kept out of the models and sets
    the cut, all of them.  Labels join the texts by broadcast up to ``label_rows`` rows, by a shuffle beyond."""
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(True))
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("label")))
    if known.count() <= label_rows:
        known = F.broadcast(known)
    fold = F.pmod(F.xxhash64(F.col("label_id").cast("string")), F.lit(calibration))
    rows = (docs.select("doc_id", "text", (out | F.col("doc_id").isNull()).alias("held_out"))
            .join(known, F.col("doc_id") == F.col("label_id"), "left")
            .select("doc_id", "text", "held_out",
                    F.when(~F.col("held_out") & (fold != 0), F.col("label")).alias("class"),
                    F.when(~F.col("held_out") & (fold == 0), F.col("label")).alias("check")))
    scored = stored(evidence(rows.drop("class"), fit(rows, order, shared), order, passage, slice_bytes), "toxicity")
    found = best_cut(scored, clean)
    if found is None:
        score = F.lit(0.0)
    else:
        cut, scale = found[0], max(found[1], 1e-6) / 2
        score = F.lit(1.0) / (F.lit(1.0) + F.exp((F.lit(cut) - F.col("evidence")) / F.lit(scale)))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "evidence")


@register("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labels of the rows
    whose crc32(doc_id) is not divisible by 5."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return classify(docs, table(spark, sf_dir, "labels"), held_out=held)
