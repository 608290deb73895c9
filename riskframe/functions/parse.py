"""Column parsers.

Every parser takes and returns a ``Column`` built from native Spark functions,
so it runs inside whole-stage codegen — no Python UDF anywhere. Parsers that
accept several input types decide on the type at plan time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

# Fixed values that must equal the modelled pipeline's for the same results:
# date formats tried in order (Spark pattern syntax), the term bin edges and
# labels, and the zero-pad width of post codes.
DATE_FORMATS = ["yyyy/M/d", "yyyy-M-d", "yyyy-M", "yyyy/M", "MMM-yy", "MMM-yyyy"]
TERM_BIN_EDGES = [-1.0, 36.0, 60.0, math.inf]
TERM_BIN_LABELS = ["<=36", "37-60", ">60"]
POSTCODE_WIDTH = 3
TWO_DIGIT_YEAR_PIVOT = 69  # 'yy' values >= 69 belong to the 1900s
# Shape of the text each format can parse; the (costly) parser only runs on
# strings of the right shape.
DATE_SHAPES = {
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M": r"^\d{4}-\d{1,2}$",
    "yyyy/M": r"^\d{4}/\d{1,2}$",
    "MMM-yy": r"^[A-Za-z]{3}-\d{2}$",
    "MMM-yyyy": r"^[A-Za-z]{3}-\d{4}$",
}
# Other spellings of a date: the text that holds it, and its format.
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
OTHER_DATES = (
    (r"^(\d{8})$", "yyyyMMdd"),
    (r"^(\d{4}-\d{1,2}-\d{1,2})" + _TIME, "yyyy-M-d"),
    (r"^(\d{4}/\d{1,2}/\d{1,2})" + _TIME, "yyyy/M/d"),
    (r"^(\d{4}\.\d{1,2}\.\d{1,2})" + _TIME, "yyyy.M.d"),
    (r"^(\d{1,2}/\d{1,2}/\d{4})" + _TIME, "M/d/yyyy"),
    (r"^([A-Za-z]{3} \d{4})$", "MMM yyyy"),
    (r"^([A-Za-z]{4,9} \d{4})$", "MMMM yyyy"),
    (r"^([A-Za-z]{4,9}-\d{4})$", "MMMM-yyyy"),
    (r"^([A-Za-z]{3} \d{1,2},? \d{4})$", "MMM d[','] yyyy"),
    (r"^([A-Za-z]{4,9} \d{1,2},? \d{4})$", "MMMM d[','] yyyy"),
    (r"^(\d{1,2} [A-Za-z]{3} \d{4})$", "d MMM yyyy"),
    (r"^(\d{1,2} [A-Za-z]{4,9} \d{4})$", "d MMMM yyyy"),
    (r"^(\d{4})$", "yyyy"),
)


def _first_int(s: Column) -> Column:
    """First run of digits as a double, null when there is none."""
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).cast("double")


def parse_term(c: Column, dtype: DataType) -> Column:
    """R1 term → months: numbers <= 10 are years; strings use the first integer,
    times 12 when the text says "year"."""
    if isinstance(dtype, NumericType):
        x = c.cast("double")
        return F.when(x <= 10, x * 12).otherwise(x)
    s = F.lower(c.cast("string"))
    n = _first_int(s)
    return F.when(F.instr(s, "year") > 0, n * 12).otherwise(n)


def parse_emp_length(c: Column) -> Column:
    """R2 employment length → years: "10" anywhere → 10, "<" → 0, else the first
    integer; no digits (n/a, none) → null."""
    s = F.lower(F.trim(c.cast("string")))
    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(F.instr(s, "10") > 0, F.lit(10.0))
        .when(F.instr(s, "<") > 0, F.lit(0.0))
        .otherwise(_first_int(s))
    )


def emp_length_token(c: Column) -> Column:
    """R3 employment-length token: "10+", "<1", the digits, or "na"."""
    s = F.lower(F.trim(c.cast("string")))
    digits = F.regexp_extract(s, r"(\d+)", 1)
    return (
        F.when(c.isNull(), F.lit("na"))
        .when(F.instr(s, "10") > 0, F.lit("10+"))
        .when(F.instr(s, "<") > 0, F.lit("<1"))
        .when(digits != "", digits)
        .otherwise(F.lit("na"))
    )


def parse_date(c: Column) -> Column:
    """R4 multi-format month parser → DATE (null when no format matches).

    Formats are tried in a fixed order. Two-digit years follow the usual
    pivot: 'Apr-71' is 1971, 'Apr-01' is 2001. The two-digit pattern only sees
    strings that end in exactly two digits, so it never swallows 'Apr-2001'.
    """
    s = F.trim(c.cast("string"))
    attempts = []
    for fmt in DATE_FORMATS:
        ts = F.when(s.rlike(DATE_SHAPES[fmt]), F.try_to_timestamp(s, F.lit(fmt)))
        if fmt == "MMM-yy":
            yy = F.substring(s, -2, 2).try_cast("int")
            ts = F.when(
                yy >= TWO_DIGIT_YEAR_PIVOT, F.add_months(ts.cast("date"), -1200)
            ).otherwise(ts.cast("date"))
        attempts.append(ts.cast("date"))
    return F.coalesce(*attempts, _any_date(s))


def _any_date(s: Column) -> Column:
    """The general fallback, for texts that none of the listed formats fits: further
    common spellings, with or without a time of day, the listed order deciding."""
    out = []
    for shape, fmt in OTHER_DATES:
        head = F.regexp_extract(s, shape, 1)
        out.append(F.when(head != "", F.try_to_timestamp(head, F.lit(fmt))).cast("date"))
    return F.coalesce(*out)


def postcode3(c: Column, dtype: DataType) -> Column:
    """R5 post code → text before the first '.', null → '', zero-padded to 3
    characters; longer codes are kept whole (never truncated)."""
    if isinstance(dtype, NumericType):
        s = c.try_cast("bigint").cast("string")  # NaN and ±inf have no code
    else:
        s = F.split(c.cast("string"), r"\.").getItem(0)
        s = F.when(s.isin("nan", "None", "none", "NaN"), F.lit("")).otherwise(s)
    s = F.coalesce(s, F.lit(""))
    return F.when(
        F.length(s) < POSTCODE_WIDTH, F.lpad(s, POSTCODE_WIDTH, "0")
    ).otherwise(s)


def time_key(d: Column) -> Column:
    """R8 month key year*100+month, 0 when the date is null."""
    return F.coalesce(F.year(d) * 100 + F.month(d), F.lit(0))


def month_sin(d: Column) -> Column:
    """R9 sin(2πm/12), a null month counts as January."""
    m = F.coalesce(F.month(d), F.lit(1))
    return F.sin(F.lit(2 * math.pi) * m / 12)


def month_cos(d: Column) -> Column:
    m = F.coalesce(F.month(d), F.lit(1))
    return F.cos(F.lit(2 * math.pi) * m / 12)


def credit_history_months(issue: Column, earliest: Column) -> Column:
    """R7 (issue − earliest) in days / 30."""
    return F.datediff(issue, earliest) / F.lit(30.0)


def term_bin(months: Column) -> Column:
    """R10 fixed-edge bins (-1,36], (36,60], (60,inf) with the lowest edge
    included; values below -1 and nulls stay null."""
    lo, e1, e2, _ = TERM_BIN_EDGES
    return (
        F.when((months >= lo) & (months <= e1), F.lit(TERM_BIN_LABELS[0]))
        .when((months > e1) & (months <= e2), F.lit(TERM_BIN_LABELS[1]))
        .when(months > e2, F.lit(TERM_BIN_LABELS[2]))
    )


def category_copy(c: Column) -> Column:
    """R11 the value as text; null and NaN are the one category 'nan'."""
    s = c.cast("string")
    return F.when(s.isNull() | (s == "NaN"), F.lit("nan")).otherwise(s)


def coerce_numeric(c: Column, dtype: DataType) -> Column:
    """P8 anything → double, unparsable text → null."""
    if isinstance(dtype, StringType):
        return F.trim(c).try_cast("double")
    return c.cast("double")


def finite_or_null(c: Column) -> Column:
    """P10 NaN and ±inf → null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(math.inf)), F.lit(None).cast("double")).otherwise(c)
