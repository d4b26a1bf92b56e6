"""Document fingerprints: bottom-k sketches of word shingles.

A fingerprint holds the ``K`` smallest 64-bit hashes of a text's distinct
shingles of ``WIDTH`` words (lower-cased, split at white space; a text of fewer
words is one shingle).  The sketch of a union is the ``K`` smallest of the
united sketches, so sketches of parts merge.  Two sketches estimate
resemblance and containment, one estimates the number of distinct shingles;
below ``K`` shingles all three are exact.

All work is SQL expressions inside the scan: no shuffle, no Python.

Defined cases: null, empty and wordless texts have the empty fingerprint, which
resembles only an empty one (1.0); equal texts have equal fingerprints;
repeated rows are repeated; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inventa.llm.registry import register
from inventa.session import table

K = 256
WIDTH = 5
MAX_BLOCKS = 4096
BLOCK_ROWS = 2000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the word shingles of a text, in order, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), lambda w: w != "")

    def of_hashes(h: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(h) - width)
        return (F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
                .when(F.size(h) < width, F.array(F.xxhash64(h)))
                .otherwise(F.transform(first, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def fingerprint(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles(text, width))), 1, k)


def as_text(sketch: Column) -> Column:
    """A fingerprint as a string: its hashes in order, hexadecimal, by commas."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def from_text(text: Column) -> Column:
    """The fingerprint that :func:`as_text` wrote."""
    def number(h: Column) -> Column:
        high = F.conv(F.left(h, F.lit(8)), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(F.conv(F.right(h, F.lit(8)), 16, 10).cast("long"))

    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ","), number))


def union(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index, 0 to 1; exact where both have under k."""
    def estimate(u: Column) -> Column:
        common = F.array_intersect(a, b)
        whole = (F.size(a) < k) & (F.size(b) < k)
        return (F.when(F.size(u) == 0, F.lit(1.0))
                .when(whole, F.size(common) / F.size(u))
                .otherwise(F.size(F.array_intersect(common, F.slice(u, 1, k))) / F.lit(k)))

    return let(F.sort_array(F.array_union(a, b)), estimate)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: 1 for an empty a, null where
    none of a's hashes lies in the range that b's sketch covers."""
    top = F.least(*[F.when(F.size(x) < k, F.lit(2**63 - 1)).otherwise(F.coalesce(F.get(x, F.size(x) - 1), F.lit(0)))
                    for x in (a, b)])
    return let(top, lambda t: let(
        F.filter(a, lambda x: x <= t),
        lambda low: F.when(F.size(a) == 0, F.lit(1.0)).when(
            F.size(low) > 0, F.size(F.array_intersect(low, b)) / F.size(low))))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    last = F.get(a, F.lit(k - 1)).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((last + 2.0**63) / 2.0**64))


def merge(parts: DataFrame, key: str, sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """Fingerprint per key over many parts.  Hashes are made distinct and cut to
    the k smallest before they are gathered, so no key's parts meet whole."""
    rows = parts.select(F.col(key).alias("key"), F.explode_outer(sketch).alias("h")).distinct()
    small = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last())))
    return (small.where(F.col("r") <= k).groupBy("key").agg(F.sort_array(F.collect_list("h")).alias(sketch))
            .withColumnRenamed("key", key))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint) with ``next_text`` and ``next_fingerprint`` of
    the row that follows in descending doc_id (equal ids by text; a null id is
    the least); the first row follows the last.

    Ids sampled by hash, at most ``MAX_BLOCKS``, split the order into blocks.
    A block's rows go to one task together with a copy of the first row of the
    block after it, so texts are shuffled once and no order is built in one
    place."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-2**63)).cast("long").alias("k"),
                       F.coalesce("text", F.lit("")).alias("text"))
    every = max(BLOCK_ROWS, rows.count() // (MAX_BLOCKS // 2))
    cuts = sorted(r["k"] for r in rows.select("k").distinct().where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
                  .orderBy(F.xxhash64("k"), "k").limit(MAX_BLOCKS).collect())
    coarse = [cuts[i] for i in range(0, len(cuts), 64)]
    fine = [cuts[i:i + 64] for i in range(0, len(cuts), 64)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("k")))

    if cuts:
        group = below(F.array(*map(F.lit, coarse)))
        within = below(F.coalesce(F.get(F.array(*[F.array(*map(F.lit, c)) for c in fine]), group - 1),
                                  F.array().cast("array<bigint>")))
        rows = rows.withColumn("block", group * 64 + within)
    else:
        rows = rows.withColumn("block", F.lit(0))
    heads = rows.groupBy("block").agg(F.max("k").alias("k")).collect()
    order = sorted((r["block"], r["k"]) for r in heads)[::-1]
    follows = spark.createDataFrame(
        [(order[(i + 1) % len(order)][1], b) for i, (b, _) in enumerate(order)], "k long, goes_to int")
    ghosts = (rows.join(F.broadcast(follows), "k")
              .select("doc_id", "k", "text", F.col("goes_to").alias("block"), F.lit(True).alias("ghost")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(tasks, "block")
             .withColumn("fingerprint", fingerprint(F.col("text"))))
    after = Window.partitionBy("block").orderBy("ghost", F.col("k").desc(), "text")
    return (dealt.withColumn("next_text", F.lead("text").over(after))
            .withColumn("next_fingerprint", F.lead("fingerprint").over(after)).where(~F.col("ghost"))
            .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"))


@register("op4_fingerprint")
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    rows = with_next(table(spark, sf_dir, "documents"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next_text", half))
    return (rows.withColumnRenamed("fingerprint", "own").withColumn("edited", edited)
            .withColumn("edited_own", fingerprint(F.col("edited")))
            .select("doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_own")).alias("edited_fingerprint"),
                    resemblance(F.col("own"), F.col("edited_own")).alias("near_edited"),
                    resemblance(F.col("own"), F.col("next_fingerprint")).alias("near_next"),
                    distinct_count(F.col("own")).alias("n_shingles")))
