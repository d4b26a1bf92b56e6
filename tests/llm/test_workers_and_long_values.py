"""Workers without the package, very long values, brute-force scans."""

import os
import re
import subprocess
import sys
import tempfile
import textwrap
from itertools import chain

import numpy as np
from pyspark.sql import functions as F

from inventa.llm import bpe, fingerprint, pii

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_operators_run_where_workers_lack_the_package():
    """The driver finds the package by sys.path alone; the workers start in
    another folder without PYTHONPATH."""
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        from inventa import llm
        for name in ("op2_language_id", "op5_decontamination", "op13_fill_in_middle"):
            print(name, llm.QUERIES[name](spark, {SF!r}).count())
        docs = spark.read.parquet({SF + "/documents.parquet"!r}).limit(20)
        labels = spark.read.parquet({SF + "/labels.parquet"!r})
        print("op12", llm.toxicity.classify(docs, labels).count())
        print("op7", llm.bpe.encode(docs).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["SPARK_LOCAL_IP"] = "127.0.0.1"
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tempfile.mkdtemp(prefix="inventa-test-"), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "op13_fill_in_middle 200" in out.stdout and "op12 20" in out.stdout and "op7 20" in out.stdout


def test_long_mail_names_and_domains(spark):
    texts = ["x@" + "a." * 500_000, "x@" + "a." * 500_000 + "com!", "name" * 50_000 + "@mail.example.com", "@" * 200_000, "a" * 500_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows, "k").collect()}
    assert got[0] == texts[0] and got[3] == texts[3] and got[4] == texts[4]
    assert got[1] != texts[1] and got[1][1:] == texts[1][1:]
    assert got[2] != texts[2] and re.fullmatch(r"[a-z]{200000}@mail\.example\.com", got[2])
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(pii.pseudonymise(rows, "k"), "k", inverse=True).collect()}
    assert back == dict(enumerate(texts))


_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


def test_mail_scan_against_the_plain_pattern(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b1", ".", "..", "@", "-", " ", "com", "x.de", "é", "7"]) for _ in range(rng.randrange(1, 40)))
             for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", F.regexp_extract_all("text", F.lit(pii.PATTERNS["email"]), F.lit(0)).alias("f")).collect()
    for r in found:
        assert r["f"] == _MAIL.findall(r["text"]), r["text"]


def _scan(text):
    """Kinds of the findings of a text, by Python's re and plain checks."""
    import datetime

    def card(v):
        d = [int(c) for c in re.sub(r"\D", "", v)][::-1]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    def date(v):
        for form in ("%m/%d/%Y", "%Y-%m-%d", "%d.%m.%Y"):
            try:
                return 1700 <= datetime.datetime.strptime(v, form).year < 2100
            except ValueError:
                continue
        return False

    def ssn(v):
        d = v.replace("-", "")
        return not re.match("000|666|9", d) and d[3:5] != "00" and d[5:] != "0000"

    valid = {"email": lambda v: bool(re.search("[A-Za-z0-9]", v.split("@")[0])), "date": date, "phone": lambda v: True, "ssn": ssn,
             "ip": lambda v: all(int(x) < 256 for x in v.split(".")), "card": card}
    out = []
    for m in re.finditer(pii.ANY.replace(r"\1", r"(?:\1)").replace(r"\2", r"(?:\2)"), text):
        for kind in pii.KINDS:
            own = pii.PATTERNS[kind].replace(r"(?<=[ .-])\d{3}[ .-]", r"\d{3}[ .-]")
            if re.fullmatch(own, m[0], re.A):
                out.append((kind, m[0], valid[kind](m[0])))
                break
    return out


def test_findings_of_the_documents_against_a_plain_scan(spark):
    """Every valid finding is replaced (or, by chance, kept by the permutation)
    and all else stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", pii.replaced(F.col("text"), "k").alias("r")).select("doc_id", "text", "r.*").collect()
    total = 0
    for r in rows:
        want = _scan(r["text"] or "")
        changed = [k for k, _, ok in want if ok]
        total += len(changed)
        assert len(r["kinds"] or []) <= len(changed)
        assert len(changed) - len(r["kinds"] or []) <= len(changed) // 3, (r["doc_id"], want, r["kinds"])
        for kind, value, ok in want:
            if not ok:
                assert value in r["new"]
    assert total > 10


def test_fingerprint_text_form(spark):
    rows = spark.createDataFrame([("",), ("one",), ("a b c d e f g h i j k",)], "t string").select(fingerprint.fingerprint(F.col("t")).alias("f"))
    for r in rows.select("f", fingerprint.as_text(F.col("f")).alias("s"), fingerprint.from_text(fingerprint.as_text(F.col("f"))).alias("g")).collect():
        assert r["f"] == r["g"] and r["s"].count(",") == max(0, len(r["f"]) - 1)


def test_long_pieces_and_scripts_need_no_folder(spark, tmp_path, monkeypatch):
    import public_tokenizers
    import tiktoken

    monkeypatch.chdir(tmp_path)
    texts = ["漢字かな交じり文" * 4_000, "x" * 30_000, "-=" * 5_000, "Ünïcödé " * 5_000, " " * 9_999]
    codec = bpe.Codec(*bpe._vocabulary(None, None))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(codec.tokens)})
    coded = codec.encode(texts)
    assert [ids.tolist() for ids, _ in coded] == [plain.encode(t) for t in texts]
    assert codec.decode([ids for ids, _ in coded]) == [t.encode() for t in texts]
    assert not list(tmp_path.iterdir())
    codec = bpe.Codec(*bpe._vocabulary(None, None), True)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 4)  # pieces come back from the older half, or are learned again
    for _ in range(3):
        again = [codec.encode([t])[0] for t in texts]
    assert [s for _, s in again] == [" ".join(map(str, ids.tolist())).encode() for ids, _ in coded]


def test_long_texts_decode_in_bounded_memory():
    """Three million tokens of one text: one aggregate over them ran out of memory."""
    codec = bpe.Codec(*bpe._vocabulary(None, None))
    ids = np.arange(3_000_000) % len(codec.tokens)
    first, whole, none = codec.decode([ids[:10], ids, ids[:0]])
    assert first == b"".join(codec.tokens[:10]) and none == b""
    assert whole == b"".join(map(codec.tokens.__getitem__, ids.tolist()))


def test_codec_of_a_worker_without_duckdb(monkeypatch):
    texts = ["", "it's 12  naïve\n\nfolk 👍", "a" * 500, "Ünïcödé " * 300, "語" * 90 + "-=" * 70]
    plain = bpe.Codec(*bpe._vocabulary(None, None), True)
    monkeypatch.setitem(sys.modules, "duckdb", None)
    codec = bpe.Codec(*bpe._vocabulary(None, None), True)
    assert plain.db is not None and codec.db is None
    coded = codec.encode(texts)
    assert [(ids.tolist(), s) for ids, s in coded] == [(ids.tolist(), s) for ids, s in plain.encode(texts)]
    assert codec.decode([ids for ids, _ in coded]) == [t.encode() for t in texts]


def test_pieces_are_the_matches_of_the_pattern():
    """Found by neighbouring characters or, for another pattern, by the regex module."""
    import random

    import public_tokenizers
    import regex

    assert bpe.PLAIN == public_tokenizers.PATTERN
    rng = random.Random(5)
    parts = [*"'''strevmdlST   \t\n7½Ⅳ一é!-_👍\0ß　​\x1c\x85퟿\U0010ffff", "'s", "'re", "'ll", " '", "  "]
    slices = [["".join(rng.choices(parts, k=rng.randrange(rng.choice((1, 4, 15))))) for _ in range(rng.randrange(6))]
              for _ in range(4000)]
    slices.append(["".join(a + chr(x) for x in chain(range(0xD800), range(0xE000, 0x110000))) for a in ("a", " ", "'")])
    for pattern in (bpe.PLAIN, r"\p{L}+|\P{L}"):
        codec, plain = bpe.Codec(*bpe._vocabulary(None, pattern)), regex.compile(pattern)
        assert (codec.kinds is None) == (pattern != bpe.PLAIN)
        for texts in slices:
            pieces, cut = codec._split(texts)
            pieces = pieces.to_pylist()
            assert [pieces[a:b] for a, b in zip(cut, cut[1:])] == [[m.encode() for m in plain.findall(t)] for t in texts]
