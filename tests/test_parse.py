"""Row parsers against the hand-made cases of FIXTURES.md §5."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from riskframe.functions import derive, parse


def _col(spark, values, dtype):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def _vals(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_term_numeric_and_text(spark):
    num = _col(spark, [3, 36, None], "int")
    assert _vals(num, parse.parse_term(F.col("v"), num.schema["v"].dataType)) == [36.0, 36.0, None]
    txt = _col(spark, ["3 years", "36 months", "x", None], "string")
    assert _vals(txt, parse.parse_term(F.col("v"), StringType())) == [36.0, 36.0, None, None]


def test_employment_length(spark):
    df = _col(spark, ["10+ years", "< 1 year", "3 years", None, "n/a"], "string")
    assert _vals(df, parse.parse_emp_length(F.col("v"))) == [10.0, 0.0, 3.0, None, None]
    assert _vals(df, parse.emp_length_token(F.col("v"))) == ["10+", "<1", "3", "na", "na"]


def test_dates(spark):
    vals = ["2012/7/1", "2012-07-01", "2012-07", "2012/07", "Apr-01", "Apr-71", "Apr-2001", "zzz", None]
    got = _vals(_col(spark, vals, "string"), parse.parse_date(F.col("v")))
    d = dt.date
    assert got == [d(2012, 7, 1)] * 4 + [d(2001, 4, 1), d(1971, 4, 1), d(2001, 4, 1), None, None]


def test_postcode(spark):
    df = _col(spark, [12.0, None, 137.0, 1234.0], "double")
    assert _vals(df, parse.postcode3(F.col("v"), DoubleType())) == ["012", "000", "137", "1234"]
    s = _col(spark, ["12.0", "nan", "1234.0"], "string")
    assert _vals(s, parse.postcode3(F.col("v"), StringType())) == ["012", "000", "1234"]


def test_term_bin(spark):
    df = _col(spark, [36.0, 37.0, 60.0, 61.0, None, -5.0], "double")
    assert _vals(df, parse.term_bin(F.col("v"))) == ["<=36", "37-60", "37-60", ">60", None, None]


def test_time_key_and_cyclic(spark):
    df = spark.createDataFrame([(0, dt.date(2015, 3, 1)), (1, None)], "i int, v date")
    assert _vals(df, parse.time_key(F.col("v"))) == [201503, 0]
    sin = _vals(df, parse.month_sin(F.col("v")))
    assert abs(sin[0] - 1.0) < 1e-12 and abs(sin[1] - 0.5) < 1e-12


def test_row_stats_skip_and_zero(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, c double")
    skip = derive.row_stats(derive.n_array(["a", "b", "c"], "skip"))
    r = df.select(*[v.alias(k) for k, v in skip.items()]).first()
    assert r["n_sum"] == 4.0 and r["n_mean"] == 2.0 and abs(r["n_std"] - 1.41421356) < 1e-6
    zero = derive.row_stats(derive.n_array(["a", "b", "c"], "zero"))
    r = df.select(*[v.alias(k) for k, v in zero.items()]).first()
    assert abs(r["n_mean"] - 4 / 3) < 1e-12 and r["n_nonzero"] == 2.0
    ext = derive.row_stats_ext(derive.n_array(["a", "b", "c"], "zero"))
    r = df.select(*[v.alias(k) for k, v in ext.items()]).first()
    assert r["n_top3"] == 4.0 and abs(r["n_pos_rate"] - 2 / 3) < 1e-12


def test_row_quantile_matches_numpy(spark):
    import numpy as np

    rows = [(1.0, 5.0, 2.0, None), (4.0, None, None, None), (3.0, 3.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    a = derive.n_array(["a", "b", "c", "d"], "skip")
    got = [r[0] for r in df.select(derive.row_quantile(a, 0.25)).collect()]
    for row, g in zip(rows, got):
        vals = [v for v in row if v is not None]
        assert abs(np.quantile(vals, 0.25) - g) < 1e-12
