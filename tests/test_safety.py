"""NaN, infinity, null and duplicate safety of parsers, fits and audits; the raw loader."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from riskframe.functions import derive, parse
from riskframe.operators import audit, encode, stats
from riskframe.plans import features
from riskframe.session import checkpoint_dir
from riskframe.sources import loans

NAN, INF = float("nan"), float("inf")


def test_parsers_take_nan_and_infinity(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,), (None,), (7.0,), (1234.0,)], "x double")
    t = df.schema["x"].dataType
    got = [tuple(r) for r in df.select(parse.postcode3(F.col("x"), t), parse.category_copy(F.col("x")), derive.clip("x", 0.0, 100.0)).collect()]
    assert [g[0] for g in got] == ["000", "000", "000", "000", "007", "1234"]
    assert got[0][1] == got[3][1] == "nan"
    assert [g[2] for g in got] == [None, 100.0, 0.0, None, 7.0, 100.0]


def test_row_statistics_skip_nan(spark):
    df = spark.createDataFrame([(1.0, NAN), (None, 3.0)], "a double, b double")
    for nulls, want in (("zero", [1.0, 3.0]), ("skip", [1.0, 3.0])):
        s = derive.row_stats(derive.n_array(["a", "b"], nulls))
        assert [r[0] for r in df.select(s["n_sum"]).collect()] == want


def test_missing_indicator_and_fits_see_nan(spark):
    df = spark.createDataFrame([(1, 1.0, 2), (2, NAN, None), (3, INF, 4), (4, 3.0, 9)], "id long, x double, k int")
    assert [r["x_isna"] for r in stats.add_missing_indicator(df, ["x"]).orderBy("id").collect()] == [0, 1, 1, 0]
    assert stats.fit_median(df, ["x", "k"]) == {"x": 2.0, "k": 4.0}
    lo, hi = stats.fit_winsor(df, ["x"], 0.0)["x"]
    assert (lo, hi) == (1.0, 3.0)
    card = {r["cat_col"]: r["nunique"] for r in encode.cardinality(df.withColumn("z", F.lit(None).cast("string")), ["k", "z"]).collect()}
    assert card == {"k": 4, "z": 1}


@pytest.mark.parametrize("text, want", [
    ("July 2001", (2001, 7, 1)), ("2012-07-01 00:00:00", (2012, 7, 1)), ("20120701", (2012, 7, 1)), ("7/4/2012", (2012, 7, 4)),
    ("2012-07-01T10:11:12Z", (2012, 7, 1)), ("Jul 4, 2012", (2012, 7, 4)), ("July 4 2012", (2012, 7, 4)), ("4 Jul 2012", (2012, 7, 4)),
    ("2012", (2012, 1, 1)), ("2012-07", (2012, 7, 1)), ("Apr-71", (1971, 4, 1)), ("20121399", None), ("soon", None), ("", None), (None, None),
])
def test_general_date_fallback(spark, text, want):
    got = spark.createDataFrame([(text,)], "d string").select(parse.parse_date(F.col("d"))).first()[0]
    assert got == (datetime.date(*want) if want else None)


def _loans(spark, n=240):
    rng = random.Random(4)
    names = [f.name for f in loans.raw_schema().fields]
    rows = []
    for i in range(n):
        r = {c: round(rng.random() * 50, 2) for c in names}
        r |= {"id": i, "term": rng.choice([3, 5]), "grade": rng.choice("ABC"), "subGrade": rng.choice(["A1", "B2"]), "employmentLength": rng.choice(["10+ years", "< 1 year", "3 years", ""]),
              "homeOwnership": rng.randint(0, 3), "verificationStatus": rng.randint(0, 2), "issueDate": rng.choice(["2014-07-01", "2015-01-01", "2015-02-01", "Mar-2016", "July 2016"]),
              "isDefault": rng.randint(0, 1), "purpose": rng.randint(0, 5), "postCode": float(rng.randint(1, 900)), "regionCode": rng.randint(0, 9), "initialListStatus": 0,
              "applicationType": 0, "earliesCreditLine": rng.choice(["Apr-2001", "Aug-99"]), "dti": rng.choice([NAN, "", 12.5]), "n0": rng.choice(["", 1.0])}
        rows.append(r)
    return names, rows


def _write_csv(spark, names, rows):
    path = f"{checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}/loans.csv"
    text = [tuple(None if r[c] == "" else str(r[c]) for c in names) for r in rows]
    spark.createDataFrame(text, ", ".join(f"{c} string" for c in names)).coalesce(1).write.csv(path, header=True)
    return path


def test_raw_csv_feeds_all_builders(spark):
    names, rows = _loans(spark)
    test_names = [c for c in names if c != "isDefault"]
    df = loans.read_train_test(spark, _write_csv(spark, names, rows[:200]), _write_csv(spark, test_names[::-1], rows[200:]))
    assert len(names) == 47 and df.filter("is_train = 1").count() == 200 and df.filter("is_train = 0 and isDefault is not null").count() == 0
    assert df.schema["purpose"].dataType.typeName() == "string" and df.schema["id"].dataType.typeName() == "long"
    for version, build in features.BUILDERS.items():
        ft = build(df)
        got = ft.df.collect()
        assert len(got) == 240, version
        numbers = [c for c in ft.features if c not in ft.cat_features]
        assert not any(r[c] is None or r[c] != r[c] or abs(r[c]) == INF for r in got for c in numbers if ft.df.schema[c].dataType.typeName() == "double"), version
        if version == "v1":
            by = {r["id"]: r for r in got}
            for r in rows:
                assert by[r["id"]]["fico_mean"] == pytest.approx((r["ficoRangeLow"] + r["ficoRangeHigh"]) / 2)
                assert by[r["id"]]["loan_income_ratio"] == pytest.approx(r["loanAmnt"] / (r["annualIncome"] + 1))
                assert by[r["id"]]["dti"] == pytest.approx(12.5)  # the median of what is known
                share = sum(q["postCode"] == r["postCode"] for q in rows) / 240
                assert by[r["id"]]["postCode_freq"] == pytest.approx(share)


def test_unique_ids_are_required(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    with pytest.raises(ValueError, match="not unique"):
        loans.require_unique(df)


def _history(spark):
    rng = random.Random(6)
    rows = [(i, 200000 + rng.randint(1, 6), rng.choice("abc"), rng.randint(0, 1), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, time_key int, grade string, isDefault int, is_train int")
    return encode.past_rate(df, ["grade"])


def test_past_rate_audit_passes_the_encoder_and_finds_a_planted_error(spark):
    df = _history(spark)
    clean = audit.audit_past_rate(df, "isDefault").first()
    assert clean["mae"] < 1e-12 and clean["rows_compared"] == 400
    broken = df.withColumn("hist_rate_grade", F.col("hist_rate_grade") + F.when(F.col("grade") == "a", 0.1).otherwise(0.0))
    share = df.filter("grade = 'a'").count() / 400
    assert audit.audit_past_rate(broken, "isDefault").first()["mae"] == pytest.approx(0.1 * share)


def test_monthly_auc_counts_all_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1), (1, 0, NAN), (2, 1, 0.5)], "time_key int, y int, s double")
    got = {r["time_key"]: (r["auc"], r["n"]) for r in audit.monthly_auc(df, "y", ["s"]).collect()}
    assert got == {1: (1.0, 3), 2: (None, 1)}


def test_columns_by_text():
    assert audit.list_by_text(["a_te", "te_b", "c", "a_te"], "te") == ["a_te", "te_b"]
