"""Hard-negative mining by angular triangle filtering.

A row's vector is its components as integers (``floor(scale * x)``); the score
of two rows is their integer inner product.  Each row stores its norm and its
angles to a few reference directions (spread over a bounded sample of
``sample_bound`` rows by farthest-point choice).  By the triangle inequality the
angle of two vectors lies between the difference and the sum of their angles to
any direction; the cosine interval times the norms, widened by more than the
rounding, bounds the score.

Rows are range-partitioned by label, nearest direction and angle into blocks.
An anchor goes only to the blocks whose bounds meet the score windows it still
looks for; inside a block, which is sorted by angle, only the rows between two
searched positions are scored.  Two searches use this:

* positives: the first ``positives`` other rows of the anchor's label;
* negatives: per positive of score p, the first ``negatives`` rows of other
  labels with ``low * p <= 100 * score <= high * p``.

Each runs over a share of the blocks first; the k-th best found there raises the
lower end of the windows for the others.  Blocks of anchors meet blocks of rows,
each of bounded size, whatever the table holds.

Defined cases: rows with a null id, label or vector or a null or non-finite
component take no part; rows alike in id, label and vector are one row; different
rows of one id are each a row, none of them the other's positive; equal scores
come by smaller id; a shorter vector counts as ended by zeros, and a vector of no
component scores 0 with all; components are limited to 2**62 and scores to 64
bits; a positive of negative score has no negatives; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inventa.llm.registry import register
from inventa.llm.storage import stored
from inventa.session import table

SCALE = 256
DIRECTIONS = 12
SAMPLE_BOUND = 2_000
BLOCK_ROWS = 65_536
LEAST_ROWS = 2_048
AT_ONCE = 64
SLACK = 1e-6
LIMIT = 2.0**62
TOP = 2**63 - 1


def integers(vectors, scale: int = SCALE) -> np.ndarray:
    """An Arrow column of float lists as whole float64 rows, padded with zeros."""
    import pyarrow as pa

    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    row = np.repeat(np.arange(len(size)), size)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -LIMIT, LIMIT)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows, limited to 64 bits."""
    wide = min(a.shape[1], x.shape[1])
    a, x = a[:, :wide], x[:, :wide]
    if not wide or not len(a) or not len(x):
        return np.zeros((len(a), len(x)), dtype=np.int64)
    if wide * float(np.abs(a).max()) * float(np.abs(x).max()) < 2.0**53:
        return (a @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in x]
    return np.array([[max(-TOP, min(TOP, sum(p * q for p, q in zip(u, v)))) for v in whole[1]] for u in whole[0]], dtype=np.int64)


def angles(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm of each row, angle to each direction; a right angle for no length)."""
    wide = min(x.shape[1], directions.shape[1])
    norm = np.sqrt((x * x).sum(axis=1))
    cos = (x[:, :wide] @ directions[:, :wide].T) / np.where(norm, norm, 1.0)[:, None]
    return norm, np.arccos(np.clip(cos, -1.0, 1.0))


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Unit directions far apart: each the sampled row of least cosine to those
    already chosen, the first one along the mean."""
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return np.zeros((0, x.shape[1]))
    first = int(np.argmax(unit @ unit.mean(axis=0)))
    chosen, near = [first], unit @ unit[first]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def _usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite))


def _directions(rows: DataFrame, scale: int, count: int, bound: int) -> np.ndarray:
    import pyarrow as pa

    some = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(bound).toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    column = some.column("embedding").combine_chunks()
    return spread(integers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, scale), count)


def _blocks(rows: DataFrame, directions: np.ndarray, scale: int, block_rows: int) -> DataFrame:
    """The rows with norm, angles and the number of their block, stored."""
    held = rows.sparkSession.sparkContext.broadcast(directions)
    kind = rows.schema["embedding"].dataType.simpleString()

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            norm, theta = angles(integers(batch.column(2), scale), held.value)
            near = theta.argmin(axis=1) if theta.shape[1] else np.zeros(len(norm), dtype=np.int64)
            own = theta[np.arange(len(norm)), near] if theta.shape[1] else np.zeros(len(norm))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), pa.array(list(theta), pa.list_(pa.float64())), pa.array(near), pa.array(own)],
                ["vec_id", "label", "embedding", "norm", "theta", "near", "own"])

    def once(batches):
        """Rows alike lie side by side; the first of them stays."""
        import pyarrow as pa

        last = None
        for batch in batches:
            keep = []
            for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                keep.append(key != last)
                last = key
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = f"vec_id long, label long, embedding {kind}, norm double, theta array<double>, near long, own double"
    indexed = stored(rows.mapInArrow(index, schema), "angles")
    total = indexed.count()
    parts = max(-(-total // block_rows), min(total // LEAST_ROWS, rows.sparkSession.sparkContext.defaultParallelism), 1)
    dealt = (indexed.repartitionByRange(parts, "label", "near", "own", "vec_id")
             .sortWithinPartitions("label", "near", "own", "vec_id", "embedding").mapInArrow(once, schema))
    return stored(dealt.drop("near", "own").withColumn("block", F.spark_partition_id()), "blocks")


def _parts(anchors: DataFrame, rows: int, blocks: int, block_rows: int) -> DataFrame:
    """The anchors with the number of their part: those of neighbouring blocks,
    and dealt by id where these hold more than ``block_rows``."""
    share = max(1, blocks * block_rows // max(rows, 1))
    anchors = anchors.withColumn("home", F.expr(f"block div {share}")).drop("block")
    size = anchors.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("deals"))
    part = F.col("home") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("deals"))
    return anchors.join(size, "home").withColumn("part", part).drop("home", "deals")


def _bounds(blocks: DataFrame, directions: int) -> DataFrame:
    """Per block: ranges of labels, norms and angles."""
    per = [f(F.col("theta")[r]).alias(f"{n}{r}") for r in range(directions) for n, f in (("a", F.min), ("z", F.max))]
    low, high = (F.array(*[F.col(f"{n}{r}") for r in range(directions)]).cast("array<double>") for n in "az")
    return blocks.groupBy("block").agg(
        F.min("label").alias("least_label"), F.max("label").alias("most_label"), F.min("norm").alias("least_norm"),
        F.max("norm").alias("most_norm"), *per).select(
        "block", "least_label", "most_label", "least_norm", "most_norm", low.alias("low"), high.alias("high"))


def _meets(directions: int) -> Column:
    """Whether the block's score bounds meet an anchor's windows."""
    d = list(range(directions))
    apart = F.greatest(F.lit(0.0), F.lit(0.0), *[g for r in d for g in (F.col("theta")[r] - F.col("high")[r], F.col("low")[r] - F.col("theta")[r])])
    total = F.least(F.lit(np.pi), F.lit(np.pi), *[g for r in d for g in (
        F.col("theta")[r] + F.col("high")[r], F.lit(2 * np.pi) - F.col("theta")[r] - F.col("low")[r])])
    most, least = F.cos(F.greatest(apart - SLACK, F.lit(0.0))), F.cos(F.least(total + SLACK, F.lit(np.pi)))
    room = F.lit(1.0) + F.lit(1e-9) * F.col("norm") * F.col("most_norm")
    upper = F.col("norm") * most * F.when(most >= 0, F.col("most_norm")).otherwise(F.col("least_norm")) + room
    lower = F.col("norm") * least * F.when(least >= 0, F.col("least_norm")).otherwise(F.col("most_norm")) - room
    wanted = F.col("windows")
    return ((upper >= F.array_min(F.transform(wanted, lambda w: w["lo"])).cast("double"))
            & (lower <= F.array_max(F.transform(wanted, lambda w: w["hi"])).cast("double")))


def between(alpha: np.ndarray, a_norm: np.ndarray, theta: np.ndarray, norm: np.ndarray, lo: np.ndarray,
            hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions among ascending ``theta`` outside which no row's
    score with the anchor can lie between lo and hi."""
    least, most = float(norm.min()), float(norm.max())

    def angle(score, length):
        safe = np.where(a_norm * length > 0, a_norm * length, 1.0)
        return np.arccos(np.clip(np.where(a_norm * length > 0, score / safe, np.sign(score)), -1.0, 1.0))

    low = lo.astype(np.float64) - 1 - 1e-9 * np.abs(lo.astype(np.float64))
    high = hi.astype(np.float64) + 1 + 1e-9 * np.abs(hi.astype(np.float64))
    # the score reaches lo only within this angle; zero-length rows score 0
    wide = np.where(low > 0, angle(low, most), angle(low, least) if least > 0 else np.pi) + SLACK
    # and stays at or below hi only beyond this one
    narrow = np.where((high >= 0) & (a_norm * least > 0), angle(high, least), 0.0) - SLACK
    first = np.searchsorted(theta, np.maximum(alpha - wide, narrow - alpha), side="left")
    last = np.searchsorted(theta, alpha + wide, side="right")
    return first, np.maximum(first, last)


def first_in_window(score: np.ndarray, ids: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
    """Positions of the k largest scores between lo and hi, ties by smaller id."""
    at = np.flatnonzero((score >= lo) & (score <= hi))
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _search(scale: int, same: bool, k: int):
    """One block of rows against one block of anchors: best k of each window."""
    def run(rows, anchors):
        import pyarrow as pa

        out = {"anchor": [], "slot": [], "vec_id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            x, ids = integers(rows.column("embedding"), scale), rows.column("vec_id").to_numpy()
            label, norm = rows.column("label").to_numpy(), rows.column("norm").to_numpy()
            theta = np.array(rows.column("theta").to_pylist()).reshape(len(ids), -1)
            a = integers(anchors.column("embedding"), scale)
            a_id, a_own = anchors.column("anchor").to_numpy(), anchors.column("vec_id").to_numpy()
            a_label, a_norm = anchors.column("label").to_numpy(), anchors.column("norm").to_numpy()
            alpha = np.array(anchors.column("theta").to_pylist()).reshape(len(a_id), -1)
            windows = anchors.column("windows").to_pylist()
            lo = np.array([min(w["lo"] for w in ws) for ws in windows])
            hi = np.array([max(w["hi"] for w in ws) for ws in windows])
            # the direction whose angles differ most within the block cuts best
            r = int(theta.std(axis=0).argmax()) if theta.shape[1] else -1
            t, al = (theta[:, r], alpha[:, r]) if r >= 0 else (np.zeros(len(ids)), np.zeros(len(a_id)))
            order = np.argsort(t, kind="stable")
            x, ids, label, norm, t = x[order], ids[order], label[order], norm[order], t[order]
            parts = [np.flatnonzero(a_label == v) for v in np.unique(a_label)]
            for part in parts:
                if same:
                    use = np.flatnonzero(label == a_label[part[0]])
                    if not len(use):
                        continue
                    bx, bid, bnorm, bt = x[use], ids[use], norm[use], t[use]
                    blocked = None
                else:
                    bx, bid, bnorm, bt = x, ids, norm, t
                    blocked = label == a_label[part[0]]
                first, last = between(al[part], a_norm[part], bt, bnorm, lo[part], hi[part])
                part = part[np.argsort(first, kind="stable")]
                first, last = between(al[part], a_norm[part], bt, bnorm, lo[part], hi[part])
                for at in range(0, len(part), AT_ONCE):
                    f, z = int(first[at:at + AT_ONCE].min()), int(last[at:at + AT_ONCE].max())
                    if f >= z:
                        continue
                    score = products(a[part[at:at + AT_ONCE]], bx[f:z])
                    for row, p in zip(score, part[at:at + AT_ONCE].tolist()):
                        barred = bid[f:z] == a_own[p] if same else blocked[f:z]
                        open_at = np.flatnonzero(~barred)
                        s, i = row[open_at], bid[f:z][open_at]
                        for w in windows[p]:
                            best = first_in_window(s, i, w["lo"], w["hi"], k)
                            out["anchor"].extend([int(a_id[p])] * len(best))
                            out["slot"].extend([w["slot"]] * len(best))
                            out["vec_id"].extend(i[best].tolist())
                            out["score"].extend(s[best].tolist())
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _found(anchors: DataFrame, blocks: DataFrame, bounds: DataFrame, directions: int, scale: int, same: bool, k: int) -> DataFrame:
    """Best k rows of every window over the given blocks (rank not yet final)."""
    spread_over = 64
    deal = max(1, -(-bounds.count() // spread_over))
    narrow = anchors.select("anchor", "label", "norm", "theta", "windows").withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    meets = _meets(directions)
    if same:
        meets = meets & F.col("label").between(F.col("least_label"), F.col("most_label"))
    met = (narrow.join(bounds.withColumn("deal", F.pmod("block", F.lit(deal))), "deal").where(meets).select("anchor", "block"))
    sent = anchors.join(met, "anchor")
    asked = sent.select(F.col("part").alias("asker"), "block").distinct()
    left = blocks.join(asked, "block").groupBy("asker", "block")
    return left.cogroup(sent.groupBy("part", "block")).applyInArrow(
        _search(scale, same, k), "anchor long, slot long, vec_id long, score long")


def _searched(anchors: DataFrame, blocks: DataFrame, bounds: DataFrame, directions: int, scale: int, same: bool, k: int) -> DataFrame:
    """Best k rows of every window of every anchor, with their rank."""
    total = bounds.count()
    step = max(1, int(total ** 0.5))
    early = bounds.where(F.pmod("block", F.lit(step)) == 0)
    found = stored(_best(_found(anchors, blocks, early, directions, scale, same, k), k), "found")
    if step == 1:
        return found
    # k rows at least this good are known: the others need not look lower
    reached = found.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("reached"))
    raised = (anchors.select("anchor", F.explode("windows").alias("w")).select("anchor", "w.*")
              .join(reached, ["anchor", "slot"], "left")
              .groupBy("anchor").agg(F.collect_list(F.struct(
                  "slot", F.greatest("lo", "reached").alias("lo"), "hi")).alias("windows")))
    later = anchors.drop("windows").join(raised, "anchor")
    late = bounds.where(F.pmod("block", F.lit(step)) != 0)
    more = _found(later, blocks, late, directions, scale, same, k)
    return stored(_best(found.drop("rank").unionByName(more), k), "found")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = SCALE, directions: int = DIRECTIONS, sample_bound: int = SAMPLE_BOUND,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Hard negatives of the rows that ``anchor`` marks (a condition on vec_id):
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``rows`` has vec_id, label and embedding."""
    usable = _usable(rows)
    chosen = _directions(usable, scale, directions, sample_bound)
    blocks = _blocks(usable, chosen, scale, block_rows)
    bounds = stored(_bounds(blocks, len(chosen)), "bounds")
    marked = _parts(blocks.where(anchor), blocks.count(), bounds.count(), block_rows)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(-TOP).alias("lo"), F.lit(TOP).alias("hi")))
    marked = stored(marked.withColumn("anchor", F.monotonically_increasing_id()).withColumn("windows", everything), "anchors")
    near = _searched(marked, blocks, bounds, len(chosen), scale, True, positives)
    near = stored(near.select("anchor", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), "positives")
    # ceil(low * p / 100) and floor(high * p / 100) without leaving 64 bits
    def part_of(percent: int, up: bool) -> Column:
        rest = F.expr("positive_score % 100") * percent / 100
        return F.expr("positive_score div 100") * percent + (F.ceil(rest) if up else F.floor(rest)).cast("long")

    windows = near.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct(
        "slot", part_of(low, True).alias("lo"), part_of(high, False).alias("hi"))).alias("windows"))
    hard = _searched(marked.drop("windows").join(windows, "anchor"), blocks, bounds, len(chosen), scale, False, negatives)
    own = marked.select("anchor", F.col("vec_id").alias("anchor_id"))
    return (hard.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                        F.col("score").alias("negative_score"))
            .join(near, ["anchor", "slot"]).join(own, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


@register("op11_hard_negatives", """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
