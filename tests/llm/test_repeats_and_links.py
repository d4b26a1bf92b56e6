"""Substring removal, the Jaccard join and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from inventa.llm import jaccard, secrets, substrings
from inventa.llm.storage import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, node int, m int, grams int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "u", 1, 2, 3) for i, t in texts], SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \n"), (None, "solo words here"), (4, "a b"), (5, "A  b"), (6, "x " * 9000), (6, "x " * 9000)]


# --- 8: substrings


def _brute_removal(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[k:k + length] for _, t in raw for k in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((i, len(t), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), kept))
    return out


def _removed(df):
    return [(r["doc_id"], r["n_bytes"], [(s["a"], s["b"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()]


def _sortable(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r)))


def _passages(seed):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, docs = [text(25) for _ in range(4)], []
    for i in range(60):
        p = random.choice(shared)
        cut = random.randint(0, 40)
        docs.append((i + 10, text(random.randint(0, 20)) + p[cut:] + text(random.randint(0, 20)) + (p[:60] if i % 3 else "")))
    docs += [(100, shared[0]), (101, shared[0]), (102, "ab" * 80), (103, "b" + "ab" * 40), (104, shared[1] * 2), (104, shared[1] * 2)]
    return docs


@pytest.mark.parametrize("hot", [10_000, 3])
def test_substrings_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "ROWS_AT_ONCE", 20)
    docs = _passages(1) + EDGE
    got = _removed(substrings.remove(frame(spark, docs), length=40, gram=13, hot=hot))
    assert _sortable(got) == _sortable(_brute_removal(docs, 40))


def test_substrings_of_production_length(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()] + EDGE[:5]
    got = _removed(substrings.remove(frame(spark, docs)))
    assert _sortable(got) == _sortable(_brute_removal(docs, 400)) and any(s for _, _, s, _ in got)
    assert substrings.remove(frame(spark, [])).collect() == []


def _brute_passages(docs, n):
    split = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    seen = Counter(tuple(w[k:k + n]) for _, w in split for k in range(len(w) - n + 1))
    return [(i, len({j for k in range(len(w) - n + 1) if seen[tuple(w[k:k + n])] > 1 for j in range(k, k + n)})) for i, w in split]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeated_passages_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "ROWS_AT_ONCE", 20)
    few = random.Random(4)
    docs = _passages(1) + EDGE + [(200 + i, "".join(few.choice(["a", "B", "b", "cé"]) + few.choice([" ", ", ", "\n"]) for _ in range(60)))
                                  for i in range(40)]
    got = [(r["doc_id"], r["n_passage_words"]) for r in
           substrings.remove(frame(spark, docs), length=40, gram=13, hot=hot, words=6, word_gram=2).collect()]
    assert _sortable(got) == _sortable(_brute_passages(docs, 6)) and any(0 < n < 60 for _, n in got)


def test_repeated_passages_of_any_number_of_bytes(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))
    short, low = text(55), text(49)
    docs = [(1, f"{text(80)} {short} {text(90)}"), (2, f"{text(70)}, {short.capitalize()}. {text(40)}"), (3, text(200)),
            (4, f"{text(80)}. {low}"), (5, f"{low}. {text(80)}")]
    got = {r["doc_id"]: r for r in substrings.remove(frame(spark, docs), words=substrings.WORDS).collect()}
    assert len(short) < 400 and {i: r["n_passage_words"] for i, r in got.items()} == {1: 55, 2: 55, 3: 0, 4: 0, 5: 0}
    assert not any(r["spans"] for r in got.values())


def test_multikey_order():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (400, 5)).astype(np.uint64)
    group = rng.integers(0, 4, 400)
    order, same = substrings.multikey_order(group, words)
    keys = [(group[i], *words[i].tolist()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 400):
        a, b = keys[k - 1], keys[k]
        want = -1 if a[0] != b[0] else next((d for d in range(5) if a[d + 1] != b[d + 1]), 5)
        assert same[k] == want


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 97).astype(np.uint64)
    for width in (1, 2, 10, 97):
        assert (substrings.sliding_min(x, width) == [x[i:i + width].min() for i in range(98 - width)]).all()


# --- 10: Jaccard components


def _set(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _brute_components(docs, width, percent):
    sets = [_set(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def _near_copies(seed, copies=70):
    random.seed(seed)
    base = [f"w{random.randint(0, 400)}" for _ in range(120)]
    docs = list(EDGE)
    for i in range(copies):
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 6, 9])):
            w[random.randrange(len(w))] = f"n{random.randint(0, 9999)}"
        docs.append((100 + i, " ".join(w[:random.choice([120, 118, 110])])))
    chain = [f"c{k}" for k in range(60)]
    for i in range(12):
        docs.append((300 - i, " ".join(chain[i:i + 48])))
    docs += [(400 + i, " ".join(f"z{i}_{k}" for k in range(20))) for i in range(20)]
    return docs


@pytest.mark.parametrize("small,block", [(64, 512), (3, 8)])
@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, monkeypatch, small, block, width, percent):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = _near_copies(width)
    got = jaccard.components(frame(spark, docs), width, percent).collect()
    want = _brute_components(docs, width, percent)
    assert _sortable(map(tuple, got)) == _sortable(want)
    assert any(c is not None and d is not None and c != d for d, _, c in want)


def test_one_of_each(spark):
    docs = _near_copies(9, 20)
    got = jaccard.one_of_each(frame(spark, docs))
    assert got.columns == frame(spark, docs).columns
    want = {(d, n == 0) for d, n, c in _brute_components(docs, 5, 80) if n == 0 or d == c}
    rows = [(r["doc_id"], not _set(r["text"], 5)) for r in got.collect()]
    assert set(rows) == want and sum(1 for r in rows if not r[1]) == sum(1 for w in want if not w[1])
    assert jaccard.components(frame(spark, [])).collect() == []


def test_one_of_each_of_null_and_shared_ids(spark):
    text = lambda k: " ".join(f"{k}_{i}" for i in range(40))
    docs = [(None, text(f"n{k}")) for k in range(5)] + [(None, text("n0"))] * 2  # unlinked, one of them repeated
    docs += [(7, text("p")), (7, text("q")), (8, text("q") + " end"), (7, text("q"))]  # one id, two texts
    docs += [(5, text("r")), (None, text("r") + " end"), (None, text("s") + " end"), (None, text("s"))]  # copies without id
    docs += [(None, None), (None, ""), (7, " "), (7, " ")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(frame(spark, docs)).collect()]
    free = [r for r in kept if r[0] is None and r[1] and r[1].startswith("s_")]
    want = [(None, text(f"n{k}")) for k in range(5)] + [(7, text("p")), (7, text("q")), (5, text("r"))] + docs[-4:]
    assert len(free) == 1 and _sortable(kept) == _sortable(want + free)


def test_sets_of_many_texts_without_id(spark, monkeypatch):
    docs = [(None if i % 3 else i, " ".join(f"{k}_{i}" for i in range(40)) + end) for i, (k, end) in
            enumerate((k, end) for k in range(20) for end in ("", " end"))]
    df, fetched = frame(spark, docs), []
    whole = type(df).mapInArrow

    def counted(self, func, schema, *rest, **named):
        if schema == "node long, grams binary":
            fetched.append(self.count())
        return whole(self, func, schema, *rest, **named)

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    got = jaccard.components(df).collect()
    assert _sortable(map(tuple, got)) == _sortable(_brute_components(docs, 3, 90)) and fetched == [len(docs)]


def test_connected_chain_and_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 140)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in jaccard.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 140)) and got[200] == 100


# --- the pipeline


@pytest.fixture(scope="module")
def stages(spark):
    sf, out = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "test")
        out.append(docs)
    return [(d.columns, {r["doc_id"]: r for r in d.collect()}, d.count()) for d in out]


def test_pipeline_stages(spark, stages):
    columns = stages[0][0]
    assert all(c == columns for c, _, _ in stages[:-1]) and stages[-1][0] == columns + ["ids", "n_tokens"]
    texts = [{i: r["text"] for i, r in rows.items()} for _, rows, _ in stages]
    assert texts[1].items() <= texts[0].items() and texts[2].items() <= texts[1].items()
    docs = sorted(texts[1].items())
    assert set(texts[2]) == {d for d, n, c in _brute_components(docs, 5, 80) if n == 0 or d == c}
    assert set(texts[2]) == set(texts[3]) == set(texts[4]) == set(texts[5]) and texts[4] == texts[5]
    for i, t in texts[4].items():
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) and stages[4][1][i]["n_chars"] == len(t)


def test_pipeline_encoding_and_decontamination(spark, stages):
    from test_text_operators import _brute_hits, _tiktoken

    bench = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    before, after = ([(i, r["text"]) for i, r in sorted(stages[k][1].items())] for k in (2, 3))
    hit = {r[0] for r in _brute_hits(before, bench) if r[5]}
    assert hit and all((dict(after)[i] != t) == (i in hit) for i, t in before)
    library = _tiktoken()
    assert all(r["ids"] == library.encode_ordinary(r["text"]) for r in stages[5][1].values())


def test_secret_stage_keeps_other_text(spark):
    text = "no secrets: hexadecimal 0xff, tokens are fun, AKIA too"
    assert [r["text"] for r in secrets.redact(frame(spark, [(1, text)])).collect()] == [text]
    assert hashlib.sha256(text.encode()).hexdigest()
