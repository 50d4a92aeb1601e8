"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their checks (Luhn for payment cards, real calendar days, octets below 256) go through a
keyed Feistel network over their own format, so a pseudonym has the same shape and passes the same check, equal
values get equal pseudonyms in all documents, different ones different, and whoever has the key can go back
(inverse=True). A round adds to one half, modulo its size, a SHA-256 value of key, round and other half.

Formats: payment cards keep first digit and separators, and get a new check digit; phone numbers keep the country
code (its length by the numbering plan) or trunk digit and punctuation, and their other digits are permuted alike however
they are written: +1 882 555 9672, +18825559672 and (882) 555-9672 stay linked; social security numbers are permuted
among the valid ones, IPv4 addresses whole; days are permuted within the 400 years from 1800,
189 * 773 days in all, those with parts of one digit or a day above 12 before the month among those of the same shape; the local part of a mail address is permuted letter for letter and digit for digit.

The key is read from the session's setting spark.lodestone.pii.secret or from LODESTONE_PII_SECRET in the driver's
environment; without either the open key TEST_KEY is used, with a warning: whoever has this code can then go back.

Cases: null text stays null, empty text empty; values that fail their check stay as they are; texts of any length
are treated whole; repeated rows come out alike; an empty table gives no rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING, VARIABLE, TEST_KEY = "spark.lodestone.pii.secret", "LODESTONE_PII_SECRET", "lodestone"
# Country codes of one and two digits in the international numbering plan; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+])(?:[0-9]{13,19}|(?<![A-Za-z_])(?:[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}))(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9-])|(?<![0-9./-])[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?![0-9/])|(?<![0-9./])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])|(?<![0-9./])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9])",
    "phone": "|".join(
        (
            r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
            # 8 to 15 digits in groups of any size
            r"(?<![0-9+])\+[1-9](?:(?: ?\(|\)[ -]?|[ .-])?[0-9]){7,14}(?![0-9]|[.-][0-9])",
            r"(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ -]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9]|[.-][0-9])",
            r"(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}(?![0-9])",
            r"(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])",
            r"(?<![0-9+-])1[ .-](?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
            # national: 9 to 11 digits after a trunk 0, in groups of at least two
            r"(?<![0-9A-Za-z_+.,/-])(?=(?:[ .()-]{0,2}[0-9]){9,11}(?![0-9]|[ .-][0-9]))(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ .-])[0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}(?![0-9]|[.-][0-9])",
            r"(?<![0-9A-Za-z_+.,/-])0[0-9]{9,10}(?![0-9A-Za-z_]|[.,-][0-9])",
        )
    ),
}
ANY = "|".join(PATTERNS.values())
ROUNDS = 10
_US = r"^(?:\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})$"


def _days(day_first: bool, w: tuple[int, int], least: int = 1) -> str:
    """The days of a common year as texts like 3/12, parts of so many digits (two: filled up with 0, one: 1 to 9)."""
    lengths = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    pairs = ((d, m) if day_first else (m, d) for m in range(1, 13) for d in range(least, lengths[m - 1] + 1))
    return ",".join(f"{a:0{w[0]}}/{b:0{w[1]}}" for a, b in pairs if a < 10 ** w[0] and b < 10 ** w[1])


_WIDTHS = ((1, 1), (1, 2), (2, 1), (2, 2))
_LEAP = ",".join(str(y) for y in range(1800, 2200) if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))


def _prf(key: str, *parts) -> Column:
    """60 bits of a keyed digest."""
    said = F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint")


def _feistel(left: Column, right: Column, size_l: Column, size_r: Column, key: str, tweak, inverse: bool) -> Column:
    """A permutation of the pairs (l < size_l, r < size_r), as a struct."""
    sign = -1 if inverse else 1

    def step(s, i):
        j = F.lit(ROUNDS - 1) - i if inverse else i
        to_l = F.pmod(s["l"] + sign * F.pmod(_prf(key, tweak, j, s["r"]), size_l), size_l)
        to_r = F.pmod(s["r"] + sign * F.pmod(_prf(key, tweak, j, s["l"]), size_r), size_r)
        return F.when(j % 2 == 0, F.struct(to_l.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), to_r.alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _digits(d: Column, key: str, tweak: str, inverse: bool) -> Column:
    """A permutation of the digit strings of d's length (up to 36)."""
    n = F.length(d)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    left = F.coalesce(F.try_to_number(F.substr(d, F.lit(1), a), F.lit("9" * 18)).cast("bigint"), F.lit(0))
    right = F.substr(d, a + 1).cast("bigint")
    out = _feistel(left, right, ten(a), ten(n - a), key, F.concat(F.lit(tweak), n.cast("string")), inverse)
    done = F.transform(F.array(out), lambda s: F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, "0")).otherwise(""), F.lpad(s["r"].cast("string"), n - a, "0")))
    return F.when(n > 0, F.element_at(done, 1)).otherwise(d)


def _refill(x: Column, digits: Column) -> Column:
    """x with its digits replaced, one after the other."""

    def one(i):
        seen = F.length(F.regexp_replace(F.substr(x, F.lit(1), i), "[^0-9]", ""))
        return F.when(F.substr(x, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, seen, F.lit(1))).otherwise(F.substr(x, i, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), "")


def _luhn(d: Column) -> Column:
    """The Luhn sum of a digit string."""

    def one(i):
        v = F.substr(F.reverse(d), i, F.lit(1)).cast("int")
        w = F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)
        return w

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), one), F.lit(0), lambda s, v: s + v)


def _card(x: Column, key: str, inverse: bool) -> Column:
    d = F.regexp_replace(x, "[^0-9]", "")
    n = F.length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _digits(F.substr(d, F.lit(2), n - 2), key, "card", inverse))
    # the digit that makes the sum end in 0
    new = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(_luhn(d) % 10 == 0, F.transform(new, lambda v: _refill(x, v))[0]).otherwise(x)


def _phone(x: Column, key: str, inverse: bool) -> Column:
    d = F.regexp_replace(x, "[^0-9]", "")
    # the country code, with a trunk 0 that stands in brackets behind it; or the trunk digit of a national number
    code = F.regexp_extract(d, f"^(?:{'|'.join(SHORT_CODES)}|[0-9]{{1,3}})", 0)
    code = F.when(x.contains("(0)") & F.substr(d, F.length(code) + 1, F.lit(1)).eqNullSafe("0"), F.concat(code, F.lit("0"))).otherwise(code)
    lead = F.when(x.startswith("+"), code).when(x.rlike(_US), F.lit("")).otherwise(F.substr(d, F.lit(1), F.lit(1)))
    new = F.array(F.concat(lead, _digits(F.substr(d, F.length(lead) + 1), key, "phone", inverse)))
    return F.transform(new, lambda v: _refill(x, v))[0]


def _ssn(x: Column, key: str, inverse: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999; others are none."""
    area, group, serial = (F.split_part(x, F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = F.array(_feistel(left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", inverse))

    def said(s):
        area = s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in ((area, 3), (F.floor(s["r"] / 9999) + 1, 2), (s["r"] % 9999 + 1, 4))])

    return F.when(valid, F.transform(out, said)[0]).otherwise(x)


def _ipv4(x: Column, key: str, inverse: bool) -> Column:
    o = [F.split_part(x, F.lit("."), F.lit(i)).cast("bigint") for i in range(1, 5)]
    out = F.array(_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4", inverse))
    octet = lambda v, k: F.pmod(F.floor(v / k), F.lit(256)).cast("string")
    return F.transform(out, lambda s: F.concat_ws(".", octet(s["l"], 256), octet(s["l"], 1), octet(s["r"], 256), octet(s["r"], 1)))[0]


def _date(x: Column, key: str, inverse: bool) -> Column:
    """Forms of fixed width whose order of month and day is one go through all days of 400 years; others keep the widths of their parts."""
    first, sep = F.lit("1800-01-01").cast("date"), F.regexp_extract(x, "[-./]", 0)
    ahead = x.rlike("^[0-9]{4}")
    year = F.when(ahead, F.substring(x, 1, 4)).otherwise(F.substr(x, F.length(x) - 3)).cast("bigint")
    part = F.translate(F.when(ahead, F.substr(x, F.lit(6))).otherwise(F.substr(x, F.lit(1), F.length(x) - 5)), "-.", "//")
    a, b = F.split_part(part, F.lit("/"), F.lit(1)), F.split_part(part, F.lit("/"), F.lit(2))
    # slashed and year last: month first, unless the first part can't be one
    late = ~ahead & (sep == "/") & (a.cast("int") > 12)
    day_first = (~ahead & (sep == ".")) | late
    day = F.datediff(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.when(day_first, b).otherwise(a), 2, "0"), F.lpad(F.when(day_first, a).otherwise(b), 2, "0")).try_cast("date"), first)

    def said(y, ab):
        y, ab = y.cast("string"), F.regexp_replace(ab, "/", sep)
        return F.when(ahead, F.concat(y, sep, ab)).otherwise(F.concat(ab, sep, y))

    out = F.array(_feistel(F.floor(day / 773), F.pmod(day, F.lit(773)), F.lit(189), F.lit(773), key, "date", inverse))
    new = F.transform(out, lambda s: F.date_add(first, (s["l"] * 773 + s["r"]).cast("int")))
    whole = F.transform(new, lambda n: said(F.year(n), F.when(day_first, F.date_format(n, "dd/MM")).otherwise(F.date_format(n, "MM/dd"))))[0]

    days = None
    for order, last in ((False, False), (True, False), (True, True)):
        for w in _WIDTHS:
            if w[0] == 2 if last else w != (2, 2):
                fits = (day_first == F.lit(order)) & (late == F.lit(last)) & (F.length(a) == w[0]) & (F.length(b) == w[1])
                days = (F.when if days is None else days.when)(fits, F.lit(_days(order, w, 13 if last else 1)))
    days = F.split(days, ",")
    at = F.array_position(days, part)
    out = F.array(_feistel(year - 1800, at - 1, F.lit(400), F.size(days), key, F.concat(F.lit("day"), F.size(days).cast("string")), inverse))
    common = F.transform(out, lambda s: said(s["l"] + 1800, F.get(days, s["r"].cast("int"))))[0]
    # the 29th of February goes through the leap years
    years = F.split(F.lit(_LEAP), ",")
    out = F.array(_feistel(F.lit(0), F.array_position(years, year.cast("string")) - 1, F.lit(1), F.lit(_LEAP.count(",") + 1), key, "leap", inverse))
    leap = F.transform(out, lambda s: said(F.get(years, s["r"].cast("int")), part))[0]
    fixed = (F.length(part) == 5) & ~late
    return F.when((day >= 0) & (day < 146097), F.when(fixed, whole).when(at > 0, common).otherwise(leap)).otherwise(x)


def _email(x: Column, key: str, inverse: bool) -> Column:
    sign = -1 if inverse else 1
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    local = F.split_part(x, F.lit("@"), F.lit(1))
    half = F.floor((F.length(local) + 1) / 2).cast("int")

    def shifted(s, other, j):
        def one(i):
            c = F.substr(s, i, F.lit(1))
            k = F.pmod(_prf(key, "email", j, i, F.length(s), other), F.lit(1_000_003)).cast("int")
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c) - 1
                out = F.when(at >= 0, F.substr(F.lit(letters), F.pmod(at + sign * k, F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise("")

    def step(s, i):
        j = F.lit(3) - i if inverse else i
        return F.when(j % 2 == 0, F.struct(shifted(s["l"], s["r"], j).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], j).alias("r")))

    out = F.array(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1).alias("r")), step))
    return F.transform(out, lambda s: F.concat(s["l"], s["r"], F.substr(x, F.length(local) + 1)))[0]


def pseudonym(x: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value, by the first kind whose form it has."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    make = {"email": _email, "ipv4": _ipv4, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}
    out = None
    for kind, f in make.items():
        out = (F.when if out is None else out.when)(x.rlike(whole[kind]), f(x, key, inverse))
    return out.otherwise(x)


def mask(text: Column, key: str, inverse: bool = False) -> tuple[Column, Column]:
    """The text with pseudonyms, and how many values were found."""
    hits, gaps = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    new = F.array_join(F.transform(hits, lambda h, i: F.concat(pseudonym(h, key, inverse), F.get(gaps, i + 1))), "")
    some = text.rlike("[0-9@]") & text.rlike(ANY)  # most texts have neither digit nor @
    return F.when(some, F.concat(F.get(gaps, F.lit(0)), new)).otherwise(text), F.when(some, F.size(hits)).otherwise(0).cast("bigint")


def key_of(spark: SparkSession) -> str:
    """The key of the session, or of the environment; else TEST_KEY, with a warning."""
    found = spark.conf.get(SETTING, None) or os.environ.get(VARIABLE)
    if not found:
        warnings.warn(f"neither {SETTING} nor {VARIABLE} is set: pseudonyms are made with the open test key", stacklevel=3)
    return found or TEST_KEY


def pseudonymise(docs: DataFrame, key: str | None = None, inverse: bool = False) -> DataFrame:
    """docs with pseudonyms in the column text; lengths stay as they are. The key is key_of() the session if not given."""
    return docs.withColumn("text", mask(F.col("text"), key or key_of(docs.sparkSession), inverse)[0])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and the number of values found."""
    text, n = mask(F.col("text"), key_of(spark))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"), n.alias("n_found"))
