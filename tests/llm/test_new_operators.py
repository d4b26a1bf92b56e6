"""Hard negatives, toxicity and fill-in-middle against brute force, with the
defined edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inventa.llm import fim, negatives, toxicity

VECTORS = "vec_id long, label int, embedding array<double>, anchor long, block int, part string"


# --- 11: hard negatives


def _brute_mine(rows, every, positives=5, negatives_=10, low=30, high=90, scale=256):
    seen = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (i, label, tuple(math.floor(scale * x) for x in v))
        if (i, label, tuple(v)) not in [s[1] for s in seen]:
            seen.append((q, (i, label, tuple(v))))
    seen = [s[0] for s in seen]
    out = []
    for a, la, va in seen:
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(va, v)), i, lb) for i, lb, v in seen))
        near = [(i, -s) for s, i, lb in scored if lb == la and i != a][:positives]
        for p, ps in near:
            hard = [(i, -s) for s, i, lb in scored if lb != la and low * ps <= -100 * s <= high * ps][:negatives_]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(hard)]
    return sorted(out)


def _vectors():
    rng = random.Random(5)
    rows = []
    centre = {k: [rng.gauss(0, 1) for _ in range(6)] for k in range(4)}
    for i in range(600):
        k = rng.randrange(4)
        rows.append((i, k, [c + rng.gauss(0, 0.8) for c in centre[k]], 1, 2, "x"))
    same = [0.5, -0.25, 1.0, 0.0, 0.5, 0.25]
    rows += [(1000 + i, 4 + i % 2, same, 1, 2, "x") for i in range(80)]
    rows += [rows[3], rows[3], (20, 1, [1.0] * 6, 1, 2, "x"), (20, 2, [1.0] * 6, 1, 2, "x"), (40, 1, [], 1, 2, "x"),
             (60, 1, [0.0] * 6, 1, 2, "x"), (2000, 2, [1.0, 0.5], 1, 2, "x"), (2020, 0, [-1.0, 2.0, 3.0], 1, 2, "x"),
             (None, 1, same, 1, 2, "x"), (2040, None, same, 1, 2, "x"), (2060, 1, None, 1, 2, "x"),
             (2080, 1, [None, 1.0], 1, 2, "x"), (2100, 1, [float("nan")] * 6, 1, 2, "x"), (2120, 1, [float("inf")], 1, 2, "x")]
    return rows


@pytest.mark.parametrize("block_rows", [1 << 16, 60])
def test_hard_negatives_against_brute_force(spark, block_rows):
    rows = _vectors()
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == _brute_mine(rows, 20)


def test_hard_negatives_of_small_tables(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], 1, 2, "x")], VECTORS)
    assert negatives.mine(one, F.col("vec_id") % 2 == 0).count() == 0


def test_products_of_huge_components_are_exact():
    a, x = np.array([[2.0**40, -3.0, 7.0]]), np.array([[2.0**40 + 2**20, 5.0, 1.0], [-LIMIT_, LIMIT_, 0.0]])
    got = negatives.products(a, x)
    assert got[0, 0] == negatives.TOP  # over 64 bits
    assert got[0, 1] == -negatives.TOP
    b = np.array([[2.0**30, 1.0]])
    assert negatives.products(b, np.array([[2.0**30, 3.0]]))[0, 0] == 2**60 + 3


LIMIT_ = negatives.LIMIT


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_angle_windows_hold_every_score_between(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(40, 3)) * rng.choice([1, 20, 3000]))
    a = np.floor(rng.normal(size=(5, 3)) * 300)
    x[rng.integers(0, 40, 3)] = 0
    directions = negatives.spread(x, 3)
    if not len(directions):
        return
    norm, theta = negatives.angles(x, directions)
    a_norm, alpha = negatives.angles(a, directions)
    order = np.argsort(theta[:, 0], kind="stable")
    score = negatives.products(a, x[order])
    lo = np.array([rng.integers(-5 * abs(s).max() - 2, 5 * abs(s).max() + 2) for s in score])
    hi = lo + rng.integers(0, 1000, len(lo))
    hi = np.maximum(hi, 0)
    first, last = negatives.between(alpha[:, 0], a_norm, theta[order, 0], norm[order], lo, hi)
    for s, f, z, p, q in zip(score, first, last, lo, hi):
        inside = np.flatnonzero((s >= p) & (s <= q))
        assert not len(inside) or (inside.min() >= f and inside.max() < z)


# --- 12: toxicity


def _folded(text):
    low = re.sub(rb"[^A-Za-z\x80-\xff]+", b" ", (text or "").encode())
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), low)


def _units(text, order):
    low = _folded(text)
    if not low:
        return []
    padded = bytes(order - 1) + low + b"\0"
    return [padded[i:i + order] for i in range(len(padded) - order + 1)]


def _brute_model(docs, order, shared):
    """n-gram -> log ratio, by the textbook recursion."""
    raw = [Counter(), Counter()]
    everything = set()
    for text, k in docs:
        for g in _units(text, order):
            everything.add(g)
            if k is not None:
                raw[k][g] += 1
    table = {(order, k): raw[k] for k in (0, 1)}
    pool = {order: everything}
    for n in range(order - 1, 0, -1):
        pool[n] = {g[1:] for g in pool[n + 1]}
        for k in (0, 1):
            if n <= shared:
                table[n, k] = Counter(g[1:] for g in pool[n + 1])
            else:
                source = {g for g, c in table[n + 1, k].items() if c}
                table[n, k] = Counter(g[1:] for g in source)
        if n == shared:  # orders below the shared one count distinct shared n-grams
            pass
    context, types, d = {}, {}, {}
    for key, counts in table.items():
        context[key], types[key] = defaultdict(int), defaultdict(int)
        for g, c in counts.items():
            context[key][g[:-1]] += c
            types[key][g[:-1]] += c > 0
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d[key] = n1 / (n1 + 2 * n2) if n1 else 0.5

    def prob(k, g):
        n = len(g)
        low = prob(k, g[1:]) if n > 1 else 1 / 257
        key, ctx = (n, k), g[:-1]
        if not context[key][ctx]:
            return low
        return (max(table[key][g] - d[key], 0) + d[key] * types[key][ctx] * low) / context[key][ctx]

    return {g: math.log(prob(1, g) / prob(0, g)) for g in everything}


TEXTS = [("You are a moron, moron!", 1), ("such scum and trash, moron", 1), ("the cat sat on the mat", 0), ("A dog and a cat.", 0),
         ("the dog ate the hat", 0), ("nobody labelled this moron", None), ("Größe über 12 Straßen", None), ("", 0), (None, 1), ("123 ...", 0)]


@pytest.mark.parametrize("order,shared", [(4, 1), (3, 2)])
def test_kneser_ney_against_the_recursion(spark, order, shared):
    docs = spark.createDataFrame(TEXTS, "text string, class int")
    got = {int(r["g"]).to_bytes(order, "big"): r["delta"] for r in toxicity.fit(docs, order, shared).collect()}
    want = _brute_model(TEXTS, order, shared)
    assert set(got) == set(want)
    for g, v in want.items():
        assert got[g] == pytest.approx(v, abs=1e-5)


def test_passage_evidence_and_slices(spark):
    docs = spark.createDataFrame(TEXTS * 2 + [("a moron " * 400 + "the cat " * 900, None)], "text string, class int")
    model = toxicity.fit(docs, 4, 1).cache()
    table = {int(r["g"]).to_bytes(4, "big"): r["delta"] for r in model.collect()}
    rows = docs.select("text", F.col("class").alias("halves"))
    one = [(r["halves"], r["evidence"]) for r in toxicity.evidence(rows, model, 4, 20).collect()]
    want = []
    for text, k in TEXTS * 2 + [("a moron " * 400 + "the cat " * 900, None)]:
        u = [table[g] for g in _units(text, 4)]
        halves = [sum(u[i:i + 10]) for i in range(0, len(u), 10)]
        want.append((k, max([sum(halves[i:i + 2]) / 20 for i in range(len(halves))], default=0.0)))
    key = lambda p: (str(p[0]), round(p[1], 4))
    for a, b in zip(sorted(one, key=key), sorted(want, key=key)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-4)
    many = [(r["halves"], r["evidence"]) for r in toxicity.evidence(rows, model, 4, 20, slice_bytes=300).collect()]
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6)


LABELS = "doc_id long, quality int, toxic int, text string"


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(3)
    plain = "the of and thing water house garden table lamp river stone bridge".split()
    rude = "moron scum trash idiot".split()
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(rude) if bad and rng.random() < 0.2 else rng.choice(plain) for _ in range(rng.randrange(30, 200))]
        rows.append((i, " ".join(words), "en", "s", 0, "x"))
        labels.append((i, 1, int(bad), "y"))
    rows += [(1000, None, None, None, None, "x"), (1001, "", None, None, None, "x"), (None, "you moron, you scum", None, None, None, "x"),
             (0, rows[0][1], "en", "s", 0, "x"), (1002, "moron scum idiot " * 30_000, None, None, None, "x"), (1003, "%% 12", None, None, None, "x")]
    labels += [(None, 1, 1, "y"), (5, 1, None, "y"), (0, 1, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")
    known = spark.createDataFrame(labels, LABELS)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    for most in (10**6, 0):  # labels broadcast, labels shuffled
        got = toxicity.classify(docs, known, held_out=held, label_rows=most).collect()
        assert len(got) == len(rows)
        out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
        right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out)
        assert len(out) > 50 and right >= 0.95 * len(out)
        by = {r["doc_id"]: r for r in got}
        assert by[None]["held_out"] and by[1000]["evidence"] == by[1001]["evidence"] == 0 and by[1000]["predicted"] == 0
        assert by[1002]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert toxicity.classify(docs.limit(0), known).count() == 0
    assert {r["score"] for r in toxicity.classify(docs.limit(5), known.limit(0)).collect()} == {0.0}


# --- 13: fill-in-middle


def _brute_fim(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc XYZ<>PSM\n\0é😀12") for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "x <P> y"), (503, "<M>"), (None, "no id at all"), (0, rows[0][1]), (0, rows[0][1]),
             (504, "word " * 60_000), (505, "a" * 300_000), (506, "漢字" * 50_000), (507, "a1" * 70_000), (508, "<" * 30 + "P" * 10 + ">")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, form string, n long")
    got = fim.fill_in_middle(docs).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted(map(tuple, got), key=key) == sorted((_brute_fim(*r) for r in rows), key=key)
    forms = Counter(r["form"] for r in got)
    assert set(forms) == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs.limit(3).withColumn("doc_id", F.lit("doc-a"))).count() == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300_000), st.integers(1, 9000)), max_size=12), st.integers(1, 5))
def test_boundary_set_selects_every_member(runs, step):
    members = np.unique(np.concatenate([np.arange(a, a + n, step) for a, n in runs] or [np.zeros(0, dtype=np.int64)])).astype(np.int64)
    found = fim.BoundarySet(members)
    assert len(found) == len(members)
    for k in [*range(0, len(members), max(1, len(members) // 97)), len(members) - 1][:200 if len(members) else 0]:
        assert found.select(k) == members[k]


def test_containers_take_the_least_form():
    assert isinstance(fim.container(np.arange(500)), fim.RunContainer)
    assert isinstance(fim.container(np.arange(0, 4000, 4)), fim.ArrayContainer)
    assert isinstance(fim.container(np.arange(0, 65536, 2)), fim.BitmapContainer)
    for low in (np.arange(500), np.arange(0, 4000, 4), np.arange(0, 65536, 2), np.array([65535])):
        made = fim.container(low)
        assert [made.select(k) for k in range(len(low))] == low.tolist()


def test_integers_of_ragged_vectors():
    got = negatives.integers(pa.array([[0.5, -0.001], [], [1.0, 2.0, 3.0]], pa.list_(pa.float32())))
    assert got.tolist() == [[128, -1, 0], [0, 0, 0], [256, 512, 768]]


def test_toxicity_cut_uses_every_checked_row(spark):
    """Against a plain scan over all edges, with ranges of few values."""
    rng = random.Random(5)
    for n, parts in ((400, 30), (400, 10_000), (3, 1)):
        rows = [(k, round(rng.gauss(k, 1), 2)) for _ in range(n) for k in (0, 1, 0)] + [(None, 99.0)]
        found = toxicity.best_cut(spark.createDataFrame(rows, "check int, evidence double"), 4.0, parts)
        toxic, clean = (np.array([x for k, x in rows if k == want]) for want in (1, 0))
        both = np.unique(np.concatenate((toxic, clean)))
        edges = [both[0] - 1e-6, *((both[1:] + both[:-1]) / 2), both[-1] + 1e-6]
        gain = [1 - np.sum(toxic < e) / len(toxic) - 4.0 * (1 - np.sum(clean < e) / len(clean)) for e in edges]
        assert abs(found[0] - edges[int(np.argmax(np.round(gain, 9)))]) < 1e-9 and abs(found[1] - clean.std()) < 1e-6
    assert toxicity.best_cut(spark.createDataFrame([(0, 1.0)], "check int, evidence double")) is None
    assert "sample" not in toxicity.classify.__code__.co_varnames
