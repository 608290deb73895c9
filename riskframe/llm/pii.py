"""Personal data replaced by format-preserving Feistel pseudonyms.

Validated numbers, dates and addresses are permuted, by a key, within their own
format: a card number stays a card number that passes its check digit, a date
stays a date. The permutation depends on the key and the value alone, so equal
values get equal pseudonyms in every document and stay linked, and distinct
values stay distinct.

Each match becomes a pair of numbers ``a < ma, b < mb``; a round adds a keyed
hash of one half to the other, modulo its range, which is a bijection for any
ranges. Everything is a projection over the row's own text: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import clean_text, fresh

ROUNDS = 8
# Formats, tried at each place from left to right. Groups are not captured.
CARD = "\\d{4}(?:[ -]?\\d{4}){3}|\\d{4}[ -]?\\d{6}[ -]?\\d{5}"
IBAN = "[A-Z]{2}\\d{2}(?: ?\\d{4}){3,6}(?: ?\\d{1,3})?"
PHONE = "\\+1[ .-]?\\(\\d{3}\\)[ .-]?\\d{3}[ .-]\\d{4}|\\+1[ .-]\\d{3}[ .-]\\d{3}[ .-]\\d{4}"
SSN = "\\d{3}-\\d{2}-\\d{4}"
IPV4 = "\\d{1,3}(?:\\.\\d{1,3}){3}"
DATE = "\\d{4}-\\d{2}-\\d{2}|\\d{2}\\.\\d{2}\\.\\d{4}|\\d{2}/\\d{2}/\\d{4}"
EMAIL = "[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,24}"
EDGE_L, EDGE_R = "(?<![\\w.@+-])", "(?![\\w@]|[.-]\\w)"
STAMP = "\\d{4}-\\d{2}-\\d{2}(?=T\\d)"  # the date of a time stamp; its time stays
ANY = f"{EDGE_L}(?:(?:{IBAN}|{CARD}|{PHONE}|{SSN}|{IPV4}|{DATE}|{EMAIL}){EDGE_R}|{STAMP})"
# The 73,049 days from 1900-01-01 to 2099-12-31 are 17 x 4297: two halves hold exactly the days, leap days like others.
FIRST_DAY, DAYS, DAYS_A, DAYS_B = "1900-01-01", 73_049, 17, 4297


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _num(s: Column) -> Column:
    return F.coalesce(s.try_cast("bigint"), F.lit(0).cast("bigint"))


def _pad(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string (its last digit counts once)."""
    backwards = F.split(F.reverse(digits), "")
    twice = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    nums = F.transform(F.filter(backwards, lambda x: x != ""), lambda x, i: twice(x.cast("int"), i))
    return F.aggregate(nums, F.lit(0), lambda s, x: s + x)


def _iban_rest(country: Column, check: Column, bban: Column) -> Column:
    """The number (bban, country as digits, check) modulo 97, nine digits at a time."""
    letter = lambda i: (F.ascii(F.substring(country, i, 1)) - 55).cast("string")
    whole = F.concat(bban, letter(1), letter(2), check)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)), F.lit(7)), lambda i: F.substr(whole, i, F.lit(7)))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda r, p: (F.concat(r.cast("string"), p).cast("bigint")) % 97)


def _date_of(s: Column) -> Column:
    iso = F.when(s.rlike("^\\d{4}-"), s)
    dot = F.when(s.contains("."), F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))
    slash = F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 1, 2), F.substring(s, 4, 2))
    day = F.coalesce(iso, dot, slash).try_cast("date")
    return F.when(F.date_diff(day, F.lit(FIRST_DAY).cast("date")).between(0, DAYS - 1), day)


def _state(kind: str, a: Column, ma, b: Column, mb, keep: Column | None = None) -> Column:
    lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return F.struct(
        F.lit(kind).alias("kind"), lit(a).alias("a"), lit(ma).alias("ma"), lit(b).alias("b"), lit(mb).alias("mb"),
        (keep if keep is not None else F.lit("")).alias("keep"),
    )


def _halves(kind: str, d: Column, keep: Column) -> Column:
    """A digit string as two halves."""
    n = F.length(d)
    k = (n / 2).cast("int")
    return _state(kind, _num(F.substr(d, F.lit(1), k)), F.pow(F.lit(10), k), _num(F.substr(d, k + 1, n - k)), F.pow(F.lit(10), n - k), keep)


def read(s: Column) -> Column:
    """The state of a match: its kind, its two halves and their ranges; null if it doesn't validate."""
    d = _digits(s)
    octet = lambda i: _num(F.split_part(s, F.lit("."), F.lit(i)))
    ip_ok = (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256)
    area, group, serial = _num(F.substring(d, 1, 3)), _num(F.substring(d, 4, 2)), _num(F.substring(d, 6, 4))
    ssn_ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    day = _date_of(s)
    nth = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    bban = F.substr(d, F.lit(3))
    luhn_ok = (luhn_sum(d) % 10 == 0) & ~s.rlike("^0+$")
    return (
        F.when(
            s.rlike(f"^(?:{IBAN})$"),
            F.when(_iban_rest(F.substring(s, 1, 2), F.substring(d, 1, 2), bban) == 1, _halves("iban", bban, F.substring(s, 1, 2))),
        )
        .when(s.rlike(f"^(?:{CARD})$"), F.when(luhn_ok, _halves("card", F.substr(d, F.lit(2), F.length(d) - 2), F.substring(d, 1, 1))))
        .when(s.rlike(f"^(?:{PHONE})$"), _state("phone", _num(F.substring(d, 2, 5)), 100_000, _num(F.substring(d, 7, 5)), 100_000))
        .when(s.rlike(f"^(?:{SSN})$"), F.when(ssn_ok, _state("ssn", area - F.when(area > 666, 2).otherwise(1), 898, (group - 1) * 9999 + serial - 1, 99 * 9999)))
        .when(s.rlike(f"^(?:{IPV4})$"), F.when(ip_ok, _state("ip", octet(1) * 256 + octet(2), 65_536, octet(3) * 256 + octet(4), 65_536)))
        .when(
            s.rlike(f"^(?:{DATE})$"),
            F.when(day.isNotNull(), _state("date", F.floor(nth / DAYS_B), DAYS_A, nth % DAYS_B, DAYS_B)),
        )
        .when(s.contains("@"), _state("email", F.lit(0), 1, F.lit(0), 1, s))
    )


def _keyed(key: str, r: int, kind: Column, half: Column) -> Column:
    """A keyed hash of one half as a number under 2^52."""
    text = F.concat_ws("|", F.lit(key), F.lit(str(r)), kind, half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def _round(key: str, r: int, s: Column) -> Column:
    a = F.pmod(s["a"] + _keyed(key, r, s["kind"], s["b"]), s["ma"]) if r % 2 == 0 else s["a"]
    b = F.pmod(s["b"] + _keyed(key, r, s["kind"], s["a"]), s["mb"]) if r % 2 else s["b"]
    return F.struct(s["kind"].alias("kind"), a.alias("a"), s["ma"].alias("ma"), b.alias("b"), s["mb"].alias("mb"), s["keep"].alias("keep"))


def _step(key: str, r: int):
    return lambda s: F.when(s.isNotNull(), _round(key, r, s))


def _refill(shape: Column, digits: Column) -> Column:
    """Put the digits, in order, where the shape has digits."""
    taken = F.transform(
        F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    )
    return F.array_join(taken, "")


def write(s: Column, old: Column, key: str) -> Column:
    """The pseudonym: the permuted state in the shape of the old value."""
    width = lambda m: F.length((m - 1).cast("string"))
    plain = F.concat(_pad(s["a"], width(s["ma"])), _pad(s["b"], width(s["mb"])))
    body = F.concat(s["keep"], plain, F.lit("0"))
    card = F.concat(s["keep"], plain, F.pmod(F.lit(10) - luhn_sum(body) % 10, F.lit(10)).cast("string"))
    check = F.lpad((98 - _iban_rest(s["keep"], F.lit("00"), plain)).cast("string"), 2, "0")
    iban = F.concat(F.substring(old, 1, 2), _refill(F.substr(old, F.lit(3)), F.concat(check, plain)))
    area = s["a"] + F.when(s["a"] + 1 >= 666, 2).otherwise(1)
    ssn = F.concat(_pad(area, F.lit(3)), _pad((s["b"] / 9999).cast("bigint") + 1, F.lit(2)), _pad(s["b"] % 9999 + 1, F.lit(4)))
    ip = F.concat_ws(".", (s["a"] / 256).cast("bigint"), s["a"] % 256, (s["b"] / 256).cast("bigint"), s["b"] % 256)
    # Clipped, since other kinds' halves are far greater than any day.
    nth = F.least(s["a"] * DAYS_B + s["b"], F.lit(DAYS - 1)).cast("int")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), nth)
    yyyy, mm, dd = (F.date_format(day, f) for f in ("yyyy", "MM", "dd"))
    date = (
        F.when(old.rlike("^\\d{4}-"), F.concat_ws("-", yyyy, mm, dd)).when(old.contains("."), F.concat_ws(".", dd, mm, yyyy)).otherwise(F.concat_ws("/", mm, dd, yyyy))
    )
    user, rest = F.split_part(old, F.lit("@"), F.lit(1)), F.split_part(old, F.lit("@"), F.lit(2))
    tag = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(old)), 256)
    email = F.concat(F.lit("u"), F.substr(tag, F.lit(1), F.lit(16)), F.lit("@"), rest)
    return (
        F.when(s["kind"] == "card", _refill(old, card))
        .when(s["kind"] == "iban", iban)
        .when(s["kind"] == "phone", _refill(old, F.concat(F.lit("1"), plain)))
        .when(s["kind"] == "ssn", _refill(old, ssn))
        .when(s["kind"] == "ip", ip)
        .when(s["kind"] == "date", date)
        .when(s["kind"] == "email", F.when(user.isNotNull(), email))
        .otherwise(old)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input with ``text`` pseudonymised, plus ``found`` and ``n_found``.

    ``found``: array of (kind, old, new) in text order; ``n_found``: its size.
    Numbers that look alike but don't validate (a failing check digit, an octet
    over 255, no such day) stay as they are. Null text becomes empty text with
    nothing found. Every input row gives one row and the other columns are kept
    (``found`` and ``n_found`` are overwritten if they exist); the result has the
    old values in ``found``, so drop it before publishing.
    """
    text = clean_text(text_col)
    hits = F.regexp_extract_all(text, F.lit(ANY), 0)
    states = F.transform(hits, read)
    for r in range(ROUNDS):
        states = F.transform(states, _step(key, r))
    new = F.zip_with(hits, states, lambda old, s: F.struct(s["kind"].alias("kind"), old.alias("old"), F.coalesce(F.when(s.isNotNull(), write(s, old, key)), old).alias("new")))
    own_text, own = fresh(docs, "_pii_text", "_pii")
    out = docs.withColumn(own_text, text).withColumn(own, F.when(F.col(own_text).rlike("[0-9@]"), new).otherwise(F.expr("array()").cast("array<struct<kind:string,old:string,new:string>>")))
    between = F.split(F.col(own_text), ANY, -1)
    joined = F.array_join(F.zip_with(between, own, lambda s, f: F.concat(s, F.coalesce(f["new"], F.lit("")))), "")
    return (
        out.withColumn(text_col, F.when(F.size(own) > 0, joined).otherwise(F.col(own_text)))
        .withColumn("found", F.filter(own, lambda f: f["kind"].isNotNull()))
        .withColumn("n_found", F.size("found"))
        .drop(own, own_text)
    )
