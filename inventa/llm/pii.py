r"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each value found and validated is replaced by a keyed permutation of itself
within its own format, by a Feistel network over its digits (or its days, or
the characters of a mail name).  The same value under the same key gives the
same pseudonym in every document, so records stay linked; different values
never meet, and the key holder can reverse the map.

========  ======================================  =============================
kind      validated by                            permuted
========  ======================================  =============================
card      13-19 digits (plain or grouped), Luhn   all but the last digit, which
                                                  is computed anew
phone     +CC (AAA) EEE-NNNN and its variants     the digits after the country
ssn       AAA-GG-SSSS, issued areas and groups    the nine digits, walking the
                                                  cycle to an issued number
ip        four octets of 0 to 255                 the 32 bits
date      a day of 1700 to 2099, Y-M-D, M/D/Y,    the day within these 400 years
          D.M.Y                                   (146,097 = 189 x 773 days)
email     name@domain.tld                         letters and digits of the name
========  ======================================  =============================

What looks alike but is not valid is left as it is.  All work is SQL
expressions inside the scan: no shuffle, no Python.

Defined cases: null text stays null, empty text empty; a text without findings
is unchanged; very long texts, names and domains are scanned whole, in time that
grows with their length; equal rows give equal rows; empty tables give none; other columns
are kept by :func:`pseudonymise`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm.fingerprint import let
from inventa.llm.registry import register
from inventa.session import table

ROUNDS = 10
KINDS = ("email", "date", "ip", "phone", "ssn", "card")
PATTERNS = {
    # labels are read by one class without two dots in a row: a group of labels would recurse once a label
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-])(?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9A-Za-z./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9A-Za-z/-])",
    "ip": r"(?<![0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<=[ .-])\d{3}[ .-]|(?<![0-9.-])\d{3}[.-])\d{3}[ .-]\d{4}(?![0-9])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])",
}
#: back references renumbered for the joint pattern
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: a text without any of these has no finding: spares the joint pattern
HINT = r"@|[0-9]{3}|[0-9][./][0-9]"
DAYS_FROM = "1700-01-01"
DAYS = (189, 773)


def _round_value(key: str, tweak: Column, number: Column, value: Column) -> Column:
    """60 keyed pseudo-random bits of a round."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, number, value), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column,
            inverse: bool = False) -> Column:
    """Permutation of the pairs (0 <= left < left_size, 0 <= right <
    right_size): even rounds add to the left part, odd ones to the right."""
    sign = -1 if inverse else 1

    def step(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(a + sign * F.pmod(_round_value(key, tweak, r, b), left_size), left_size)).otherwise(a).alias("a"),
            F.when(even, b).otherwise(F.pmod(b + sign * F.pmod(_round_value(key, tweak, r, a), right_size), right_size)).alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), step)


def permute_digits(digits: Column, key: str, tweak: str, inverse: bool = False) -> Column:
    """A digit string (up to 36 digits) permuted among those of its length."""
    size = F.char_length(digits)
    half = F.floor(size / 2).cast("int")
    ten = F.lit(10).cast("double")

    def radix(n: Column) -> Column:
        return F.pow(ten, n).cast("long")

    def joined(ab: Column) -> Column:
        return F.concat(F.when(half == 0, "").otherwise(F.lpad(ab["a"].cast("string"), half, "0")),
                        F.lpad(ab["b"].cast("string"), size - half, "0"))

    left = F.when(half == 0, F.lit(0)).otherwise(F.left(digits, half).cast("long"))
    return let(feistel(left, F.right(digits, size - half).cast("long"), radix(half), radix(size - half), key,
                       F.concat(F.lit(tweak), size.cast("string")), inverse), joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.char_length(_digits(F.left(shape, i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(shape)), at), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string (0: valid)."""
    size = F.char_length(digits)

    def of(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((size - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), size), of), F.lit(0), lambda n, x: n + x) % 10


def _card(value: Column, key: str, inverse: bool) -> Column:
    def changed(d: Column) -> Column:
        body = permute_digits(F.left(d, F.char_length(d) - 1), key, "card", inverse)
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return let(_digits(value), lambda d: F.when(luhn_sum(d) == 0, refill(value, changed(d))).otherwise(value))


def _phone(value: Column, key: str, inverse: bool) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.char_length(country) + 1, F.lit(40))
    return F.concat(country, refill(rest, permute_digits(_digits(rest), key, "phone", inverse)))


def _issued(d: Column) -> Column:
    return ~(d.rlike("^(000|666|9)") | d.rlike("^...00") | d.rlike("0000$"))


def _ssn(value: Column, key: str, inverse: bool) -> Column:
    def walked(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(24)), permute_digits(d, key, "ssn", inverse),
                           lambda x, _: F.when(_issued(x), x).otherwise(permute_digits(x, key, "ssn", inverse)))

    return let(_digits(value), lambda d: F.when(_issued(d), refill(value, walked(d))).otherwise(value))


def _ip(value: Column, key: str, inverse: bool) -> Column:
    def changed(o: Column) -> Column:
        half = F.lit(65536).cast("long")
        ab = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, key, F.lit("ip"), inverse)
        return let(ab, lambda x: F.concat_ws(".", *[(F.floor(x[p] / 256) if hi else x[p] % 256).cast("string")
                                                    for p in "ab" for hi in (True, False)]))

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), changed(o)).otherwise(value))


def _date(value: Column, key: str, inverse: bool) -> Column:
    start = F.lit(DAYS_FROM).cast("date")

    def in_format(form: str) -> Column:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")

        def changed(n: Column) -> Column:
            ab = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key,
                         F.lit("date"), inverse)
            return let(ab, lambda x: F.date_format(F.date_add(start, (x["a"] * DAYS[1] + x["b"]).cast("int")), form))

        return let(F.datediff(day, start), lambda n: F.when(
            n.isNotNull() & (n >= 0) & (n < DAYS[0] * DAYS[1]), changed(n)).otherwise(value))

    return (F.when(value.contains("/"), in_format("MM/dd/yyyy")).when(value.contains("-"), in_format("yyyy-MM-dd"))
            .otherwise(in_format("dd.MM.yyyy")))


def permute_text(text: Column, key: str, tweak: str, inverse: bool = False) -> Column:
    """Letters and digits shifted within their class by a Feistel network over
    the two halves of the text; other characters stay.  The halves are arrays of
    characters and a round's key is a digest of the other half, so the work
    grows with the text's length."""
    sign = -1 if inverse else 1

    def shifted(half: Column, seed: Column) -> Column:
        def at(char: Column, i: Column) -> Column:
            c = F.ascii(char)
            k = sign * F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
            out = c
            for lo, n in ((48, 10), (65, 26), (97, 26)):
                out = F.when((c >= lo) & (c < lo + n), lo + F.pmod(c - lo + k, F.lit(n))).otherwise(out)
            return F.char(out)

        return F.transform(half, at)

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.array_join(F.when(even, acc["b"]).otherwise(acc["a"]), "")
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), other), 256)
        return let(seed, lambda s: F.struct(F.when(even, shifted(acc["a"], s)).otherwise(acc["a"]).alias("a"),
                                            F.when(even, acc["b"]).otherwise(shifted(acc["b"], s)).alias("b")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def halved(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        return F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))

    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return let(F.aggregate(rounds, let(chars, halved), step), lambda x: F.array_join(F.concat(x["a"], x["b"]), ""))


def _email(value: Column, key: str, inverse: bool) -> Column:
    return F.concat(permute_text(F.substring_index(value, "@", 1), key, "email", inverse), F.lit("@"),
                    F.substring_index(value, "@", -1))


_MAPS = {"email": _email, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """(kind, pseudonym) of one found value; kind null where it is not valid."""
    def of_kind(kind: str) -> Column:
        return let(_MAPS[kind](value, key, inverse), lambda new: F.struct(
            F.when(new != value, F.lit(kind)).alias("kind"), new.alias("new")))

    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("new"))
    for kind in reversed(KINDS):
        own = PATTERNS[kind].replace(r"(?<=[ .-])\d{3}[ .-]", r"\d{3}[ .-]")
        out = F.when(value.rlike("^(?:" + own + ")$"), of_kind(kind)).otherwise(out)
    return out


def replaced(text: Column, key: str, inverse: bool = False) -> Column:
    """(new, kinds) of a text: all valid findings replaced, and their kinds."""
    plain = F.struct(text.alias("new"), F.array().cast("array<string>").alias("kinds"))

    def with_findings(found: Column) -> Column:
        pieces = F.split(text, ANY, -1)
        new = F.zip_with(pieces, found, lambda p, f: F.concat(p, F.coalesce(f["new"], F.lit(""))))
        kinds = F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull())
        return F.struct(F.array_join(new, "").alias("new"), kinds.alias("kinds"))

    findings = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: pseudonym(v, key, inverse))
    return F.when(text.rlike(HINT), let(findings, with_findings)).otherwise(plain)


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """The rows with personal values of ``text`` replaced (or restored)."""
    return docs.select(*[replaced(F.col("text"), key, inverse)["new"].alias("text") if c == "text" else F.col(f"`{c}`")
                         for c in docs.columns])


@register("op6_pseudonyms")
def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with its personal values replaced, and their counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", replaced(F.col("text"), "inventa-example-key").alias("r"))
    counts = [F.size(F.expr(f"filter(r.kinds, x -> x = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", F.col("r.new").alias("text"), F.size("r.kinds").cast("long").alias("n_pii"), *counts)
