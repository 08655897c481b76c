"""Format-preserving pseudonyms for private values, in SQL functions only.

One regular expression finds candidates; each is validated (Luhn digits,
IBAN remainders, calendar dates, octets, lengths) and goes through a keyed
Feistel network over its own format: digits stay digits, letters stay letters
of their case, separators stay where they are, check digits are made anew,
dates stay dates.  The network is a permutation, so equal values stay linked
across documents and different values never meet; who has the key can undo it
(``reveal``).  Candidates that fail validation stay as they are.
"""

from __future__ import annotations

import os
import secrets
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting of the session, and variable of the environment, that hold the key.
KEY_SETTING, KEY_VARIABLE = "spark.tallyweft.pseudonym.key", "TALLYWEFT_PSEUDONYM_KEY"
ROUNDS = 8
#: Steps of cycle walking; one step leaves the domain with a chance below 1 in 8.
WALK = 48
DAY0, DAYS = "1900-01-01", 73_049
#: The least product of two close numbers above DAYS.
RADIX = (271, 270)

# Country calling codes of two digits (1 and 7 stand alone, all others have three).
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# How keys of well-known services begin; the beginning stays.
KEY_BEGINNING = r"(?:AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox[abpr]-|AIza|eyJ)"
_NAMES = r"(?i:\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|(?:auth|access|api|bearer)[_-]?token|client[_-]?secret)[\"']?)"

#: What stands before a value, the value, and what stands behind it; groups are named apart, as all kinds make one pattern.
KINDS = {
    "email": (r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", ""),
    "iban": (r"\b", r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"\b"),
    "service_key": (r"(?<![\w-])", r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|glpat-[\w-]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})", r"(?![\w-])"),
    # behind a name and "=", or a name, ":" and then with a digit; the first look is a cheap one
    "secret": (r"(?<=[=:\"']|[=:] )(?:(?<=" + _NAMES + r"\s{0,2}=\s{0,2}[\"']?)|(?<=" + _NAMES + r"\s{0,2}:\s{0,2}[\"']?)(?=[A-Za-z+/_-]*\d))", r"[A-Za-z0-9+/_-]{8,}", ""),
    "iso_date": (r"(?<![\w./-])", r"\d{4}-\d{2}-\d{2}", r"(?![\w/-])"),
    "date": (r"(?<![\w./-])", r"\d{1,2}(?<dot>[./])\d{1,2}\k<dot>\d{4}", r"(?![\w/-])"),
    "ip": (r"(?<![\w.-])", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?![\w-]|\.\d)"),
    "ip6": (r"(?<![\w:.])", r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})", r"(?![\w:]|\.\d)"),
    "ssn": (r"(?<![\w-])", r"\d{3}-\d{2}-\d{4}", r"(?![\w-])"),
    "bare_ssn": (r"(?<=\bSSN[ :#]{1,3}|\bssn[ :#]{1,3})", r"\d{9}", r"(?![\w-])"),
    "phone": (r"(?<![\w+(.-])", r"(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d++){1,6}|00[1-9]\d{0,2}(?:[ .-]\d++){1,5}|0[1-9]\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,6})?|\(0?\d{3}\) ?\d{3,8}(?:-\d{4})?|\d{3}-\d{3}-\d{4})", r"(?![\w-])"),
    "card": (r"(?<![\w.-])", r"(?:\d{13,19}|\d{4}(?<four>[ -])\d{4}\k<four>\d{4}\k<four>\d{1,7}|\d{4}(?<six>[ -])\d{6}\k<six>\d{5})", r"(?![\w-])"),
}
PATTERN = "|".join(f"{before}{value}{behind}" for before, value, behind in KINDS.values())

#: Every value above holds one of these or stands behind one, so a text without any of them has none.
NEEDED = r"[0-9@=]|" + KEY_BEGINNING

_own_key: list[str] = []


def session_key(spark: SparkSession | None = None) -> str:
    """The key of the session's setting or the environment; where neither is given, a random one of this process.

    Values stay linked across runs, and can be revealed, only under a key that
    was given.
    """
    spark = spark or SparkSession.getActiveSession()
    given = (spark.conf.get(KEY_SETTING, None) if spark else None) or os.environ.get(KEY_VARIABLE)
    if given:
        return given
    if not _own_key:
        _own_key.append(secrets.token_hex(32))
    return _own_key[0]


def _hash(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column, at: Column) -> Column:
    """32 bits of a digest, at one of 57 places."""
    return F.conv(F.substring(digest, (at * 5) % 57 + 1, F.lit(8)), 16, 10).cast("long")


def _shift(ch: Column, by: Column, letters: int = 26) -> Column:
    def within(first: str, size: int) -> Column:
        low = ord(first)
        return F.char(F.pmod(F.ascii(ch) - low + by, F.lit(size)) + low)

    return F.when(ch.between("0", "9"), within("0", 10)).when(ch.between("a", "z"), within("a", letters)).when(ch.between("A", "Z"), within("A", letters)).otherwise(ch)


def _sequence(n: int, undo: bool) -> Column:
    return F.sequence(F.lit(n - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(n - 1))


def permuted(x: Column, key: str, kind: str, undo: bool = False, letters: int = 26) -> Column:
    """The Feistel network over a string: each round shifts one half's characters within
    their classes (digits, and the first ``letters`` letters of either case) by a keyed hash of the other half."""
    half = F.floor(F.length(x) / 2).cast("int")

    def round_(acc: Column, r: Column) -> Column:
        left, right = F.substring(acc, F.lit(1), half), F.substring(acc, half + 1, F.length(acc))
        turn = r % 2 == 0
        digest = _hash(key, kind, r, F.length(acc), F.when(turn, right).otherwise(left))
        moved = F.transform(F.split(F.when(turn, left).otherwise(right), ""), lambda ch, i: _shift(ch, (-1 if undo else 1) * _number(digest, i), letters))
        moved = F.array_join(moved, "")
        return F.when(turn, F.concat(moved, right)).otherwise(F.concat(left, moved))

    return F.aggregate(_sequence(ROUNDS, undo), x, round_)


def _permuted_pair(u: Column, v: Column, sizes: tuple[int, int], key: str, kind: str, undo: bool) -> Column:
    """The Feistel network over a pair of numbers below ``sizes``."""
    start = F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))

    def round_(acc: Column, r: Column) -> Column:
        sign = -1 if undo else 1
        turn = r % 2 == 0
        by = _number(_hash(key, kind, r, F.when(turn, acc["v"]).otherwise(acc["u"])), F.lit(0))
        return F.struct(
            F.when(turn, F.pmod(acc["u"] + sign * by, F.lit(sizes[0]))).otherwise(acc["u"]).cast("long").alias("u"),
            F.when(turn, acc["v"]).otherwise(F.pmod(acc["v"] + sign * by, F.lit(sizes[1]))).cast("long").alias("v"),
        )

    return F.aggregate(_sequence(ROUNDS, undo), start, round_)


def _walk(x: Column, step, inside) -> Column:
    """Repeat ``step`` until the value is inside the domain again (cycle walking)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(x), lambda acc, _: F.when(inside(acc), acc).otherwise(step(acc)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _filled(x: Column, digits: Column, skip: int | Column = 0) -> Column:
    """x with its digits after the first ``skip`` replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(acc: Column, ch: Column) -> Column:
        digit = ch.between("0", "9")
        new = F.when(digit & (acc["n"] >= skip), F.substring(digits, acc["n"] - skip + 1, F.lit(1))).otherwise(ch)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + F.when(digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(x, ""), start, put)["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit weighing one."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda ch, i: F.when(i % 2 == 0, ch.cast("int")).otherwise((2 * ch.cast("int")) % 10 + F.floor(ch.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _card(x: Column, key: str, undo: bool) -> Column:
    d = _digits(x)
    body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", undo)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(d) % 10 == 0, _filled(x, F.concat(body, check))).otherwise(x)


def _iban_rest(x: Column) -> Column:
    """Remainder modulo 97 of an IBAN, its first four characters moved to the end."""
    turned = F.split(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4)), "")

    def add(acc: Column, ch: Column) -> Column:
        return F.when(ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(turned, F.lit(0), add)


def _spaced(x: Column, chars: Column) -> Column:
    """x with its characters other than spaces replaced by ``chars`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(acc: Column, ch: Column) -> Column:
        space = ch == " "
        new = F.when(space, ch).otherwise(F.substring(chars, acc["n"] + 1, F.lit(1)))
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + F.when(space, 0).otherwise(1)).alias("n"))

    return F.aggregate(F.split(x, ""), start, put)["out"]


def _iban(x: Column, key: str, undo: bool) -> Column:
    """The country stays, check digits are made anew; spaces do not count."""

    def made(v: Column) -> Column:
        country = F.substring(v, 1, 2)
        body = permuted(F.substring(v, F.lit(5), F.length(v)), key, "iban", undo)
        check = F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return F.concat(country, check, body)

    bare = F.replace(x, F.lit(" "), F.lit(""))
    return F.when(F.length(bare).between(15, 34) & (_iban_rest(bare) == 1), F.transform(F.array(bare), lambda v: _spaced(x, made(v)))[0]).otherwise(x)


def _ssn(x: Column, key: str, undo: bool) -> Column:
    def valid(d: Column) -> Column:
        return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")

    d = _digits(x)
    return F.when(valid(d), _filled(x, _walk(d, lambda v: permuted(v, key, "ssn", undo), valid))).otherwise(x)


def _phone(x: Column, key: str, undo: bool) -> Column:
    """Country codes stay, as do the zeros before them and the first two digits of a national number that begins with zero; the rest of 7 to 15 digits is permuted."""
    d = _digits(x)

    def code(after: Column) -> Column:
        return F.when(after.rlike("^[17]"), 1).when(after.rlike(f"^(?:{'|'.join(TWO_DIGIT_CODES)})"), 2).otherwise(3)

    skip = F.when(x.startswith("+"), code(d)).when(d.startswith("00"), code(F.substring(d, F.lit(3), F.length(d))) + 2).when(d.startswith("0"), 2).otherwise(0)
    rest = F.substring(d, skip + 1, F.length(d))
    return F.when(F.length(d).between(7, 15), _filled(x, permuted(rest, key, "phone", undo), skip)).otherwise(x)


def _ip6(x: Column, key: str, undo: bool) -> Column:
    """Letters in lower case before they are permuted, in the case they had after."""
    return _in_case(x, permuted(F.lower(x), key, "ip6", undo, letters=6))


def _in_case(x: Column, new: Column) -> Column:
    """``new`` in capitals where x has them."""
    return F.array_join(F.transform(F.split(new, ""), lambda ch, i: F.when(F.substring(x, i + 1, F.lit(1)).between("A", "Z"), F.upper(ch)).otherwise(ch)), "")


def _ip(x: Column, key: str, undo: bool) -> Column:
    parts = F.split(x, "\\.")
    octet = [parts[i].cast("int") for i in range(4)]
    pair = _permuted_pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], (65536, 65536), key, "ip", undo)
    # as an array of one, so that the network runs once
    made = F.transform(F.array(pair), lambda p: F.concat_ws(".", F.floor(p["u"] / 256), p["u"] % 256, F.floor(p["v"] / 256), p["v"] % 256))[0]
    valid = F.forall(parts, lambda p: p.rlike("^(0|[1-9][0-9]{0,2})$") & (p.cast("int") <= 255))
    return F.when(valid, made).otherwise(x)


def _day(n: Column, key: str, undo: bool) -> Column:
    def step(v: Column) -> Column:
        pair = _permuted_pair(F.floor(v / RADIX[1]), v % RADIX[1], RADIX, key, "date", undo)
        return F.transform(F.array(pair), lambda p: p["u"] * RADIX[1] + p["v"])[0]

    return _walk(n.cast("long"), step, lambda v: v < DAYS)


def _shown(pattern: str, n: Column) -> Column:
    return F.date_format(F.date_add(F.lit(DAY0).cast("date"), n.cast("int")), pattern)


def _date(x: Column, key: str, undo: bool) -> Column:
    """Dates of 1900 to 2099; the same day in any notation gets the same day.  With slashes the month leads, unless only the day can."""
    pad = F.regexp_replace(x, r"(?<![0-9])([0-9])(?![0-9])", "0$1")
    made = x
    for pattern, sign in (("yyyy-MM-dd", "^[0-9]{4}-"), ("dd.MM.yyyy", r"\."), ("dd/MM/yyyy", "/"), ("MM/dd/yyyy", "/")):
        day = F.datediff(F.try_to_timestamp(pad, F.lit(pattern)).cast("date"), F.lit(DAY0).cast("date"))
        shown = partial(_shown, pattern)
        moved = F.transform(F.array(_day(day, key, undo)), lambda n: shown(n))[0]  # noqa: B023  used at once
        made = F.when(x.rlike(sign) & day.between(0, DAYS - 1), moved).otherwise(made)
    # one-digit days and months stay possible: a notation without leading zeros is kept
    bare = F.regexp_replace(made, r"(?<![0-9])0([0-9])(?![0-9])", "$1")
    return F.when(x.rlike(r"(?<![0-9])[0-9](?![0-9])") & (made != x), bare).otherwise(made)


def _email(x: Column, key: str, undo: bool) -> Column:
    """The domain stays; letters of either case are the same mailbox, whose pseudonym shows the case that is there."""
    at = F.instr(x, "@")
    name = F.substring(x, F.lit(1), at - 1)
    return F.concat(_in_case(name, permuted(F.lower(name), key, "email", undo)), F.substring(x, at, F.length(x)))


def _service_key(x: Column, key: str, undo: bool) -> Column:
    start = F.regexp_extract(x, f"^{KEY_BEGINNING}", 0)
    return F.concat(start, permuted(F.substring(x, F.length(start) + 1, F.length(x)), key, "service_key", undo))


def pseudonym(x: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one candidate (a whole match of PATTERN); x itself if it is not valid."""

    def of(kind: str) -> Column:
        return x.rlike(f"^(?:{KINDS[kind][1]})$")

    return (
        F.when(of("email"), _email(x, key, undo))
        .when(of("iban"), _iban(x, key, undo))
        .when(of("service_key"), _service_key(x, key, undo))
        .when(of("iso_date") | of("date"), _date(x, key, undo))
        .when(of("ip"), _ip(x, key, undo))
        .when(of("ip6"), _ip6(x, key, undo))
        .when(of("ssn") | of("bare_ssn"), _ssn(x, key, undo))
        .when(of("card"), _card(x, key, undo))
        .when(of("phone"), _phone(x, key, undo))
        .otherwise(permuted(x, key, "secret", undo))
    )


def pseudonyms(text: Column, key: str, undo: bool = False) -> Column:
    """The text with each valid private value replaced: the pieces between the matches and the pseudonyms are joined in turn.

    The pattern is only tried on texts that hold what every value needs, which leaves none out.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    between = F.split(text, PATTERN, -1)
    new = F.transform(found, lambda x: pseudonym(x, key, undo))
    joined = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, b))), "")
    return F.when(text.rlike(NEEDED), joined).otherwise(text)


def protect(docs: DataFrame, *, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with private values replaced in ``text_col``, other columns and their order unchanged.

    One narrow pass over whole texts of any length.  Without ``key``, that of
    the session counts (``session_key``).  Null texts stay null, empty texts
    empty, repeated rows repeat, an empty table stays empty; columns of any
    names may stand beside the text.
    """
    secret = key or session_key(docs.sparkSession)
    return docs.select(*[pseudonyms(docs[c], secret).alias(c) if c == text_col else docs[c] for c in docs.columns])


def reveal(docs: DataFrame, *, text_col: str = "text", key: str | None = None) -> DataFrame:
    """Undo ``protect`` under the same key."""
    secret = key or session_key(docs.sparkSession)
    return docs.select(*[pseudonyms(docs[c], secret, undo=True).alias(c) if c == text_col else docs[c] for c in docs.columns])
