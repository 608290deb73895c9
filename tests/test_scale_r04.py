"""Boosted queries without a time limit, and tables and shuffles that go as soon as they are used."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest

from riskframe.operators import boost, encode
from riskframe.operators import train as tr
from riskframe.plans import common, features, q_train
from riskframe.sources import loans
from riskframe.sources.io import list_names, path_exists


def _rows(spark, n=200):
    rng = random.Random(5)
    out = []
    for i in range(n):
        a = rng.gauss(0, 1)
        out.append((i, int(rng.random() < 1 / (1 + np.exp(-2 * a))), a, rng.gauss(0, 1), "xyz"[i % 3]))
    return spark.createDataFrame(out, "id long, isDefault int, a double, b double, k string")


def _whole(spark, monkeypatch, query):
    """Run a boosted query over small rows; its result and what boosting was asked for and gave."""
    df, told = _rows(spark), []
    monkeypatch.setattr(q_train, "_data", lambda spark, sf_dir: (df, df.limit(10).drop("isDefault"), ["a", "b"], ["k"]))
    monkeypatch.setitem(tr.CONFIGS, "L0", tr.with_overrides(tr.CONFIGS["L0"], n_folds=2, maxDepth=2, minLeaf=5, maxIter=7, earlyStop=7, bins=16))
    real = boost.train

    def train(rows, k, params, folder, fingerprint="", deadline=None, **more):
        done = real(rows, k, params, folder, fingerprint, deadline, **more)
        told.append((deadline, done))
        return done

    monkeypatch.setattr(boost, "train", train)
    rows = query(spark, "").collect()
    assert len(told) == 1
    return rows, *told[0]


def test_boosted_predictions_have_no_time_limit(spark, monkeypatch):
    rows, deadline, done = _whole(spark, monkeypatch, q_train.q_cv_gbt)
    assert deadline is None and done.complete and [s.rounds for s in done.folds] == [7, 7]
    assert len(rows) == 210 and all(0 < r.pred < 1 for r in rows)


def test_importances_come_from_all_rounds(spark, monkeypatch):
    rows, deadline, done = _whole(spark, monkeypatch, q_train.q_importance_agg)
    assert deadline is None and done.complete and all(len(s.trees) == 7 for s in done.folds)
    assert [r.feature for r in rows][0] == "a" and {r.feature for r in rows} == {"a", "b", "k"}


def _tables(spark, folder, n=160):
    """Small driver tables with repeated and null keys."""
    rng = random.Random(8)
    day = lambda: datetime.date(1994 + rng.randint(0, 4), rng.randint(1, 12), 3)
    flags = lambda: (rng.choice("RAN"), rng.choice("OF"))
    rows = {
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string",
                   [(i if i % 50 else None, rng.randint(1, 30), day(), rng.choice(["1-URGENT", "2-HIGH", None]), rng.choice("OFP")) for i in range(1, n + 1)]),
        "lineitem": ("l_orderkey long, l_extendedprice double, l_linenumber int, l_discount double, l_tax double, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double",
                     [(rng.randint(1, n), rng.choice([None, round(rng.random() * 9e4, 2)]), rng.randint(1, 7), rng.choice([0.0, 0.05, None]), 0.02, rng.randint(1, 40), rng.randint(1, 9), *flags(), float(rng.randint(1, 50))) for _ in range(3 * n)]),
        "customer": ("c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int", [(i % 28 + 1, rng.random() * 1e4, rng.choice(["A", "B", None]), i % 5) for i in range(30)]),
        "part": ("p_partkey long, p_size int, p_retailprice double", [(i % 38 + 1, rng.randint(1, 50), rng.random() * 1e3) for i in range(40)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _kept(spark):
    """Names of the intermediate tables that are there."""
    root = common._tables_dir(spark)
    return set(list_names(spark, root)) if path_exists(spark, root) else set()


def test_staged_loans_are_the_loans(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    whole = loans.load_loans(spark, sf)
    staged, steps = loans.staged_loans(spark, sf)
    assert staged.dtypes == whole.dtypes and sorted(staged.collect(), key=str) == sorted(whole.collect(), key=str) and whole.count() > 100
    common.forget(*steps)


@pytest.mark.parametrize("version", ["src", "v2", "v3"])
@pytest.mark.parametrize("most", [100_000, 30])
def test_feature_tables_leave_one_table_and_read_it(spark, tmp_path, monkeypatch, version, most):
    """With few values a key column, and with many: then the rows are dealt out by the key, one column after the other."""
    sf = _tables(spark, tmp_path / "in")
    monkeypatch.setattr(encode, "FEW_VALUES", most)
    before = _kept(spark)
    ft = features.build_features(spark, sf, version, features.FeatureConfig(version=version, high_card_threshold=10))
    left = _kept(spark) - before
    assert len(left) == 1 and all(f"/{[*left][0]}/" in f for f in ft.df.inputFiles())
    assert "Exchange" not in ft.df._jdf.queryExecution().executedPlan().toString()  # the caller's own plan doesn't deal out rows
    # All loans are there, and the frequency a high-cardinality category gets is its share of them.
    raw = loans.load_loans(spark, sf).count()
    got = ft.df.collect()
    assert len(got) == raw and "employmentTitle_cat" in ft.meta["high_card"]
    held = Counter(r.employmentTitle_cat for r in got)
    assert all(r.employmentTitle_cat_freq == pytest.approx(held[r.employmentTitle_cat] / raw) for r in got)
    assert all(r.employmentTitle_freq == pytest.approx(held[r.employmentTitle_cat] / raw) for r in got)
    common.forget(ft.df)
    assert _kept(spark) == before


def test_shuffle_files_go_with_the_table_written(spark, tmp_path):
    before = spark.conf.get(common.REMOVE_SHUFFLES, "false")
    df = spark.range(2000).selectExpr("id % 1000 k").groupBy("k").count()
    with common.shuffles_removed(spark), common.shuffles_removed(spark):
        assert spark.conf.get(common.REMOVE_SHUFFLES) == "true"
    held = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    known = held.size()
    assert common.materialize(df).count() == 1000  # a count's own shuffle may stay
    assert held.size() - known <= 1 and spark.conf.get(common.REMOVE_SHUFFLES, "false") == before


def test_boosting_keeps_the_rows_of_one_stage(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import VectorAssembler

    df = tr._folds.stratified_folds(_rows(spark), "isDefault", 2)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df).selectExpr("id", "double(isDefault) y", "fold", "1d w", "x")
    params = {"maxIter": 2, "maxDepth": 2, "bins": 16}
    wide = boost.train(rows, 2, params, str(tmp_path / "wide"), stage=1)
    assert sorted(p.name for p in (tmp_path / "wide").glob("rows-*")) == ["rows-2"]
    # One fold after the other, where the points of two are too many: the same trees.
    monkeypatch.setattr(boost, "SIDE_BY_SIDE_BYTES", 1)
    asked, side = [], boost._side_by_side
    monkeypatch.setattr(boost, "_side_by_side", lambda spark, fn, items, most=None: asked.append(most) or side(spark, fn, items, most))
    narrow = boost.train(rows, 2, params, str(tmp_path / "narrow"), stage=1)
    assert asked.count(1) == 2
    a, b = ({r.id: (r.b0, r.b1) for r in m.margins.collect()} for m in (wide, narrow))
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
    # A training without a round leaves nothing; one with a round stays.
    boost.train(rows, 2, params, str(tmp_path / "late"), deadline=0.0)
    for name, stays in (("late", False), ("wide", True)):
        boost.discard_unstarted(spark, str(tmp_path / name))
        assert (tmp_path / name).exists() == stays


@pytest.mark.parametrize("name", ["L0", "LR", "broken"])
def test_training_leaves_its_predictions_only(spark, name):
    df = common.materialize(_rows(spark))
    before = _kept(spark)
    few = {"maxDepth": 2, "minLeaf": 5, "maxIter": 2, "bins": 16} if name == "L0" else {}
    cfg = tr.ModelConfig("broken", "none", 2, {}) if name == "broken" else tr.with_overrides(tr.CONFIGS[name], n_folds=2, **few)
    out = tr.run_models(df, df.limit(10).drop("isDefault"), ["a", "b"], [], [cfg]).collect()
    assert [r.status for r in out] == ["failed" if name == "broken" else "ok"] and _kept(spark) == before
    if name != "broken":
        res = tr.train_cv(df, df.limit(10).drop("isDefault"), ["a", "b"], [], cfg, spent=[df])
        left = _kept(spark)
        assert df.inputFiles()[0].split("/")[-2] not in left
        assert len(left - before) == 2 and res.predictions.count() == 210  # predictions, and scores in ranges for the folds' AUCs
