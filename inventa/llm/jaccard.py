"""Self-join of documents by Jaccard similarity of word n-grams.

The join is a product of the sparse document by n-gram matrix with itself,
computed in blocks and cut down by bounds that lose no pair:

1. Texts of equal sets are one *class*; all further work is on classes.
2. Grams are ordered rare first, by counts of gram buckets over all texts.  Two
   sets that link must share one of their first ``n - ceil(t n) + 1`` grams.
   Only those prefix entries are shuffled; grams of one class are dropped, and
   of grams shared by the same classes one is kept.
3. Grams of at most ``SMALL`` classes: pairs of fitting size whose 2,048-bit
   parity sketches are close enough (their distance bounds the symmetric
   difference from below) are checked on their whole sets: first one pair per
   class, then those whose classes these links leave apart.
4. Grams of more classes, as far as such links leave classes apart that the
   bounds would let link: these are dealt into blocks of about ``BLOCK``;
   each block's overlap counts are accumulated as a matrix product and only a
   spanning set of links leaves the task.  Then only classes outside the
   gram's largest component so far visit the other blocks, so that a group of
   thousands of near copies is never expanded into its pairs.

Links between classes are joined into components by alternating large-star and
small-star steps on the link table.  Set members are 64-bit hashes.

Defined cases: null, empty and wordless texts have the empty set, link with
nothing and are components of their own; a text of fewer words than the width
is one gram; repeated rows are copies; a component whose ids are all null has a
null component_id; an empty table gives no rows; other columns are ignored by
:func:`components` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inventa.llm import textops as T
from inventa.llm.registry import register
from inventa.llm.storage import stored
from inventa.session import table

SMALL = 64
BLOCK = 512
SKETCH_WORDS = 32
_SHIFT = np.uint64(48)


def gram_sets(texts: list[bytes], width: int):
    """Sorted distinct gram hashes of each text."""
    for lo, hi, buf, starts in T.chunks(texts):
        low = T.LOWER[buf]
        start, end = T.word_spans(low, T.NON_SPACE)
        word = T.span_hashes(low, start, end)
        first = np.searchsorted(T.doc_of(start, starts), np.arange(hi - lo + 1))
        gram = T.ngram_hashes(word, width)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield np.unique(gram[a:b - width + 1])
            else:
                yield T.ngram_hashes(word[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def class_id(grams: np.ndarray) -> int:
    """Signature of a set; never 0 for a set that has members."""
    with np.errstate(over="ignore"):
        h = T.mix(np.array([T.mix(grams).sum(dtype=np.uint64) + np.bitwise_xor.reduce(grams) * T.WORD_BASE], dtype=np.uint64))[0]
    return int(h.view(np.int64)) or 1


def _counts(docs: DataFrame, width: int) -> np.ndarray:
    """Number of texts' grams in each of 65,536 buckets."""
    def count(batches):
        import pyarrow as pa

        n = np.zeros(1 << 16, dtype=np.int64)
        for batch in T.sliced(batches):
            sets = list(gram_sets(T.as_bytes(batch.column(0)), width))
            if sets:
                n += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=1 << 16)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["b", "n"])

    out = np.zeros(1 << 16, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def _sketched(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, node, sketch, prefix) per row; node 0 for an empty set."""
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, width))

    def sketch(batches):
        import pyarrow as pa

        for batch in T.sliced(batches):
            n, node, bits, prefix = [], [], [], []
            for grams in gram_sets(T.as_bytes(batch.column(2)), width):
                size = len(grams)
                keep = size + percent * -size // 100 + 1 if size else 0
                order = np.lexsort((grams, counts.value[(grams >> _SHIFT).astype(np.int64)]))[:keep]
                odd = np.bincount((grams & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
                n.append(size)
                node.append(class_id(grams) if size else 0)
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                prefix.append(grams[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(bits, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n", "node", "sketch", "prefix"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n long, node long, "
                "sketch array<long>, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, grams) of the wanted (node, doc_id, text_hash): the hashes as bytes."""
    def build(batches):
        import pyarrow as pa

        seen = set()  # a repeated row joins in the same task
        for batch in T.sliced(batches):
            sets, nodes = list(gram_sets(T.as_bytes(batch.column(1)), width)), batch.column(0).to_pylist()
            own = np.array([len(s) > 0 and class_id(s) == k and not (k in seen or seen.add(k))
                            for s, k in zip(sets, nodes)], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(own)), pa.array([s.tobytes() for s, k in zip(sets, own) if k], pa.binary())],
                ["node", "grams"])

    # the hash, so that a shared or null id meets the copies of a class only
    w = wanted.select("node", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(
        w, (F.col("h") == F.col("wanted_hash")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    return texts.select("node", "text").mapInArrow(build, "node long, grams binary")


def _linked(a, b, common, percent: int):
    """Whether sets of sizes a and b with so many common members link."""
    return 100 * common >= percent * (a + b - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    def check(batches):
        import pyarrow as pa

        for batch in T.sliced(batches, 256):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                ok.append(bool(_linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections: products of the incidence matrices, summed
    over slices of the grams that both sides have."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    sides = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s)) for s in (left, right)]
    common = np.intersect1d(np.unique(sides[0][1]), np.unique(sides[1][1]), assume_unique=True)
    if left is right:
        common = np.unique(sides[0][1][np.isin(sides[0][1], common)])
    placed = []
    for row, gram in sides:
        at = np.searchsorted(common, gram)
        at[at == len(common)] = 0
        hit = common[at] == gram if len(common) else np.zeros(len(gram), dtype=bool)
        placed.append((row[hit], at[hit]))
    for lo in range(0, len(common), columns):
        blocks = []
        for (row, at), size in zip(placed, (len(left), len(right))):
            use = (at >= lo) & (at < lo + columns)
            m = np.zeros((size, min(columns, len(common) - lo)), dtype=np.float32)
            m[row[use], at[use] - lo] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    return out


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links that span each (gram, block)'s own components."""
    def span(group):
        import pyarrow as pa

        nodes = np.array(group.column("node").to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("grams").to_pylist()]
        size = np.array([len(s) for s in sets])
        near = _linked(size[:, None], size[None, :], overlaps(sets, sets), percent)
        np.fill_diagonal(near, True)
        label = np.arange(len(nodes))
        while True:
            least = np.where(near, label[None, :], len(nodes)).min(axis=1)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        own = label != np.arange(len(nodes))
        return pa.table({"a": nodes[own], "b": nodes[label[own]]})

    return members.groupBy("key", "block").applyInArrow(span, "a long, b long")


def _visits(rows: DataFrame, percent: int) -> DataFrame:
    """Links of the visitors of each (gram, block) with each component there."""
    def meet(group):
        import pyarrow as pa

        nodes = np.array(group.column("node").to_pylist(), dtype=np.int64)
        comp = np.array(group.column("comp").to_pylist(), dtype=np.int64)
        visits = np.array(group.column("visits").to_pylist(), dtype=bool)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("grams").to_pylist()]
        guests, homes = np.flatnonzero(visits), np.flatnonzero(~visits)
        a, b = [], []
        if len(guests) and len(homes):
            _, kind = np.unique(comp[homes], return_inverse=True)
            for lo in range(0, len(guests), BLOCK):
                some = guests[lo:lo + BLOCK]
                common = overlaps([sets[i] for i in some], [sets[i] for i in homes])
                sizes = np.array([len(s) for s in sets])
                near = _linked(sizes[some][:, None], sizes[homes][None, :], common, percent)
                near &= comp[some][:, None] != comp[homes][None, :]
                g, h = np.nonzero(near)
                _, first = np.unique(np.stack((g, kind[h])), axis=1, return_index=True)
                a.extend(nodes[some[g[first]]].tolist())
                b.extend(nodes[homes[h[first]]].tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "block").applyInArrow(meet, "a long, b long")


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the least node that each linked node reaches."""
    def digest(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = digest(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _links(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect the classes of ``rows`` as all their links would."""
    classes = (rows.where("node <> 0").groupBy("node")
               .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.any_value("n").alias("n"),
                    F.any_value("sketch").alias("sketch"), F.any_value("prefix").alias("prefix"))
               .select("node", "first.doc_id", "first.text_hash", "n", "sketch", "prefix"))
    classes = stored(classes, "classes")
    entries = classes.select("node", "n", F.explode("prefix").alias("key"))
    shared = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "keys")
    entries = stored(entries.join(shared, "key"), "entries")  # key, node, n
    groups = (entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
              .groupBy("m", "h").agg(F.min("key").alias("key")).select("key", "m"))
    kept = stored(entries.join(groups, "key"), "groups")

    small = kept.where(F.col("m") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    fits = ((F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
            & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")))
    sized = stored(a.join(b, fits).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "sized")
    bits = classes.select("node", "n", "sketch")

    def near(na, sa, nb, sb):
        """Size and sketch bounds: false only for pairs that cannot link."""
        apart = sum((F.bit_count(F.col(sa)[i].bitwiseXOR(F.col(sb)[i])) for i in range(SKETCH_WORDS)), F.lit(0))
        return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
                & (apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)))

    def close(candidates: DataFrame) -> DataFrame:
        both = candidates.join(bits.toDF("a", "na", "sa"), "a").join(bits.toDF("b", "nb", "sb"), "b")
        return both.where(near("na", "sa", "nb", "sb")).select("a", "b")

    pairs = stored(close(sized), "pairs")
    large = kept.where(F.col("m") > SMALL).select("key", "node", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node"))
    sets = stored(_sets(docs, wanted.distinct().join(classes.select("node", "doc_id", "text_hash"), "node"), width), "sets")

    # first each class with one partner only (its least, or a large group's):
    # what these links connect needs no further pair
    centre = large.groupBy("key").agg(F.min("node").alias("a"))
    stars = (large.join(centre, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    stars = stored(close(stars).unionByName(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), "stars")
    links = stored(_verified(stars, sets, percent), "links")
    comps = stored(connected(links).withColumnRenamed("comp", "c"), "comps")
    ca, cb = (comps.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    rest = (pairs.join(stars, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    links = stored(links.unionByName(_verified(rest, sets, percent)), "links")
    if large.isEmpty():
        return links

    def torn(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of groups of several components, with the rows' components
        and the group's main one."""
        comps = connected(found).withColumnRenamed("comp", "c")
        placed = stored(rows.join(comps, "node", "left").withColumn("comp", F.coalesce("c", "node")).drop("c"), "placed")
        main = (placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")))
        return placed.join(main.where("comps > 1"), "key")

    # of these, only members that the bounds leave a partner in another
    # component (a semi join: one row per member, however many partners)
    members = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    open_ = torn(members, links).select("key", "blocks", "block", "node", "comp").join(bits, "node")
    a, b = open_.alias("a"), open_.alias("b")
    open_ = stored(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp"))
                          & near("a.n", "a.sketch", "b.n", "b.sketch"), "left_semi")
                   .select("key", "blocks", "block", "node"), "open")
    if open_.isEmpty():
        return links
    links = stored(links.unionByName(_block_links(open_.select("key", "block", "node").join(sets, "node"), percent)), "links")
    split = torn(open_, links).where("blocks > 1")
    guests = (split.where("comp <> main").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .where("to <> block").withColumn("block", F.col("to")).withColumn("visits", F.lit(True)))
    columns = ["key", "block", "node", "comp", "visits"]
    meet = split.withColumn("visits", F.lit(False)).select(columns).unionByName(guests.select(columns)).join(sets, "node")
    return links.unionByName(_visits(meet, percent))


def components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id among the
    documents that links of at least ``percent`` % connect)."""
    rows = stored(_sketched(docs, width, percent), "sketches")
    comps = connected(_links(docs, rows, width, percent))
    slim = rows.select("doc_id", "n", "node")
    # least id per class first, so that copies meet in partial sums only
    least = slim.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = least.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    answer = stored(own.select("node", "comp").join(of_comp, "comp").select("node", "component_id"), "answer")
    joined = slim.join(answer, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per component: of its rows of least id (null ids last) that of
    least text hash; rows that repeat it in id and text are dropped too, textless
    rows stay.  Rows of other components stay whatever their id is."""
    rows = stored(_sketched(docs, width, percent), "sketches")
    comps = connected(_links(docs, rows, width, percent))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    first = (rows.where("node <> 0").groupBy("node").agg(least.alias("first")).join(comps, "node", "left")
             .groupBy(F.coalesce("comp", "node").alias("comp")).agg(F.min("first").alias("first"))
             .select(F.struct("first.doc_id").alias("id"), F.col("first.text_hash").alias("h")))
    # a struct, so that null ids are equal; the repeats go before the shuffle
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id").alias("id"),
                        F.xxhash64("text").alias("h"), (~F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]")).alias("empty"))
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    kept = every.where(~F.col("empty")).withColumn("nth", nth).where("nth = 1").join(first, ["id", "h"], "left_semi")
    return kept.select("row.*").unionByName(every.where("empty").select("row.*"))


_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY doc_id),
c AS (SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY same),
r AS (SELECT rep, n, g FROM c JOIN s ON s.doc_id = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM r a JOIN r b ON a.g = b.g AND a.rep < b.rep
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(node, to_) AS (
  SELECT rep, rep FROM c
  UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.to_),
m AS (SELECT node, min(to_) AS comp FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (same) LEFT JOIN m ON m.node = c.rep
"""


@register("op10_jaccard_components", _SQL)
def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole documents by 3-word shingles at 90 %."""
    return components(table(spark, sf_dir, "documents"))
