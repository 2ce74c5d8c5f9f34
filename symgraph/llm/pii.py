"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their check (card numbers by their check digit, addresses by their octets, dates by the
calendar, and so on) are replaced by others of the same form: a keyed Feistel network permutes the values of
each form among themselves, so equal values get equal pseudonyms in every document, different values get
different ones, and nothing but the key is needed to link or, by whoever holds it, to undo them. The rounds draw on SHA-256 of the key,
the kind of value, the round and the other half.

Texts are scanned once; no row moves.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session's setting that holds the key, and a key that anyone can read here, for trials alone.
SETTING, TRIAL_KEY = "spark.symgraph.pseudonym.key", "trial key, not secret"

#: The forms that are looked for, in order of precedence.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9](?:[ ()-]{0,2}[0-9]){7,14}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" if k != "day_date" else f"(?:{p})" for k, p in FORMS.items())
#: Days from 1900-01-01 to 2099-12-31, inside a rectangle of 271 by 270.
FIRST_DAY, DAYS, WIDE, HIGH = "1900-01-01", 73049, 271, 270


def chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def only(s: Column, kept: str) -> Column:
    return F.regexp_replace(s, f"[^{kept}]", "")


def draw(key: str, kind: str, turn: Column, other: Column, place: Column) -> Column:
    """0 to 2**32 - 1, from the key and what else there is."""
    told = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), place.cast("string"), other)
    return F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("long")


def turned(c: Column, by: Column) -> Column:
    """The letter or digit `by` places on among those of its class; any other as it is."""

    def among(first: str, n: int) -> Column:
        return F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + by) % n)

    return F.when(c.rlike("^[0-9]$"), among("0", 10)).when(c.rlike("^[a-z]$"), among("a", 26)).when(c.rlike("^[A-Z]$"), among("A", 26)).otherwise(c)


def permuted_text(s: Column, key: str, kind: str) -> Column:
    """`s` with letters and digits permuted within their classes: halves take turns to be shifted by the other."""

    def shifted(half: Column, other: Column, turn: Column) -> Column:
        told = F.concat_ws(":", F.length(half).cast("string"), other)
        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(chars(half), lambda c, i: turned(c, draw(key, kind, turn, told, i))), ""))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    step = lambda x, t: F.struct(
        F.when(t % 2 == 0, shifted(x["a"], x["b"], t)).otherwise(x["a"]).alias("a"), F.when(t % 2 == 1, shifted(x["b"], x["a"], t)).otherwise(x["b"]).alias("b")
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["a"], x["b"]))


def permuted_number(x: Column, wide: int, high: int, key: str, kind: str) -> Column:
    """A permutation of 0 .. wide * high - 1, by sums modulo `wide` and `high` in turn."""
    start = F.struct((x % wide).cast("long").alias("a"), F.floor(x / wide).cast("long").alias("b"))
    step = lambda s, t: F.struct(
        F.when(t % 2 == 0, (s["a"] + draw(key, kind, t, s["b"].cast("string"), F.lit(0))) % wide).otherwise(s["a"]).alias("a"),
        F.when(t % 2 == 1, (s["b"] + draw(key, kind, t, s["a"].cast("string"), F.lit(0))) % high).otherwise(s["b"]).alias("b"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] + s["b"] * wide)


def luhn_sum(digits: Column) -> Column:
    """The check sum of `digits`, the last of which is the check digit."""
    worth = F.transform(chars(F.reverse(digits)), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(worth, F.lit(0), lambda s, w: s + F.when(w > 9, w - 9).otherwise(w))


def filled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced by `digits` in order."""
    at = lambda i: F.length(only(F.substring(form, F.lit(1), i), "0-9"))
    each = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1))))
    return F.array_join(each, "")


def card(m: Column, key: str) -> Column:
    d = only(m, "0-9")
    body = F.concat(F.substring(d, 1, 1), permuted_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(d) % 10 == 0, filled(m, F.concat(body, check.cast("string"))))


def email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def access_key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), permuted_text(F.substring(m, 5, 16), key, "access_key"))


def phone(m: Column, key: str) -> Column:
    d = only(m, "0-9")
    return filled(m, F.concat(F.substring(d, 1, 2), permuted_text(F.substring(d, F.lit(3), F.length(d)), key, "phone")))


def ipv4(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, r"\."), i).cast("long")
    good = F.forall(F.split(m, r"\."), lambda x: (x.cast("long") <= 255) & ((x == "0") | ~x.startswith("0")))
    x = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    y = permuted_number(x, 65536, 65536, key, "ipv4")
    return F.when(good, F.aggregate(F.array(y), F.lit(""), lambda s, v: F.concat(s, F.concat_ws(".", *[(F.shiftright(v, n) % 256).cast("string") for n in (24, 16, 8, 0)]))))


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), i).cast("int") for i in range(3))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    y = permuted_number(rank.cast("long") + ((group - 1) * 9999 + serial - 1).cast("long") * 898, 898, 99 * 9999, key, "ssn")

    def shown(v: Column) -> Column:
        a, rest = v % 898, F.floor(v / 898)
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"), F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))

    return F.when(good, F.aggregate(F.array(y), F.lit(""), lambda s, v: F.concat(s, shown(v))))


def date(m: Column, key: str) -> Column:
    """ISO dates, and day, month and year with dots or slashes; one day has one pseudonym in all forms."""
    iso = m.rlike("^[0-9]{4}-")
    text = F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.try_to_date(text, "yyyy-MM-dd")
    x = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    once = lambda v: permuted_number(v, WIDE, HIGH, key, "date")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(24)), once(x.cast("long")), lambda v, _: F.when(v < DAYS, v).otherwise(once(v)))

    def shown(v: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), F.substring(m, 3, 1), F.date_format(d, "MM"), F.substring(m, 3, 1), F.date_format(d, "yyyy")))

    return F.when((x >= 0) & (x < DAYS), F.aggregate(F.array(walk), F.lit(""), lambda s, v: F.concat(s, shown(v))))


REPLACE = {"email": email, "access_key": access_key, "iso_date": date, "day_date": date, "ipv4": ipv4, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or null if it isn't valid."""
    out = None
    for kind, make in REPLACE.items():
        here = m.rlike(f"^(?:{FORMS[kind]})$")
        out = F.when(here, make(m, key)) if out is None else out.when(here, make(m, key))
    return out


def key_of(spark: SparkSession) -> str:
    """The key in the session's setting; without one the trial key, with a warning: whoever reads this file can undo its pseudonyms."""
    key = spark.conf.get(SETTING, None)
    if not key:
        warnings.warn(f"{SETTING} is not set: pseudonyms are made with a key that is no secret", stacklevel=2)
    return key or TRIAL_KEY


def pseudonymized(docs: DataFrame, key: str, found: str = "n_found", replaced: str = "n_replaced") -> DataFrame:
    """`docs` (text, any other columns) with valid personal data in `text` replaced by pseudonyms, and two columns
    more: how many places had one of the forms, and how many of them were valid and replaced.

    Null texts stay null with zeros; repeated rows give repeated results; an empty table gives no rows.
    Matches that fail their check stay. If columns named `found` or `replaced` are there already, they are replaced.
    The `key` is the caller's secret; there is no default, and an empty one is refused.
    """
    if not key:
        raise ValueError("a key is needed")
    own = [c for c in docs.columns if c not in (found, replaced)]
    text = F.col("text").cast("string")
    matches = F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], matches.alias("__m"))
    pairs = F.when(F.size("__m") > 0, F.transform("__m", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    rows = rows.select(*[F.col(f"`{c}`") for c in own], F.size("__m").cast("long").alias(found), F.coalesce(pairs, F.array().cast("array<struct<old:string,new:string>>")).alias("__p"))
    gaps = F.split(text, ANY, -1)
    after = F.concat(F.transform("__p", lambda p: F.coalesce(p["new"], p["old"])), F.array(F.lit("")))
    made = F.when(F.size("__p") == 0, text).otherwise(F.array_join(F.zip_with(gaps, after, lambda g, a: F.concat(g, a)), ""))
    n = F.size(F.filter("__p", lambda p: p["new"].isNotNull())).cast("long").alias(replaced)
    return rows.select(*[made.alias("text") if c == "text" else F.col(f"`{c}`") for c in own], found, n)
