"""Steps that fail or slow down on large tables: boosting after a long preparation, passes of linear fits, row statistics, known AUCs."""

import random
import time

import numpy as np

from riskframe.functions import derive
from riskframe.operators import blend, boost, linear
from riskframe.operators import train as tr
from riskframe.sources import loans


def _rows(spark, n=200):
    rng = random.Random(7)
    out = []
    for i in range(n):
        a = rng.gauss(0, 1)
        out.append((i, int(rng.random() < 1 / (1 + np.exp(-2 * a))), a, rng.gauss(0, 1)))
    return spark.createDataFrame(out, "id long, isDefault int, a double, b double")


def test_boosting_time_starts_with_its_rounds(spark):
    df = _rows(spark)
    cfg = tr.with_overrides(tr.CONFIGS["L0"], n_folds=2, maxDepth=2, minLeaf=5, bins=16)
    res = tr.train_cv(df, df.limit(10).drop("isDefault"), ["a", "b"], [], cfg, seconds=0.0)  # over at once: one round all the same
    assert not res.complete and [r.rounds for r in res.fold_report.collect()] == [1, 1]
    assert res.predictions.filter("pred is not null").count() == 210 and res.nodes.count() > 0


def test_least_rounds_are_not_made_anew(spark, tmp_path):
    df = tr._folds.stratified_folds(_rows(spark), "isDefault", 2)
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df).selectExpr("id", "double(isDefault) y", "fold", "1d w", "x")
    params = {"maxIter": 9, "maxDepth": 2, "bins": 16}
    for resumed in (0, 1):
        done = boost.train(rows, 2, params, str(tmp_path / "t"), deadline=time.monotonic() - 1, least=1)
        assert done.resumed == resumed and [s.rounds for s in done.folds] == [1, 1]


def test_a_sum_over_the_rows_is_one_job(spark):
    df = spark.createDataFrame([([float(i)], float(i % 2), i % 2, 0) for i in range(50)], "x array<double>, y double, fold int, inner int")
    spark.sparkContext.setJobGroup("one-sum", "")
    total = linear._tree_sum(df, lambda x, y, fold, inner: np.array([x.sum(), float(len(x))]))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-sum")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert total.tolist() == [1225.0, 50.0] and len([*jobs]) == 1


def test_column_stats_equal_the_array_ones(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.5, None), (None, None, None), (nan, 3.0, -1.0), (0.1, 0.2, 0.3), (None, -2.0, None)], "a double, b double, c double")
    for cols in (["a", "b", "c"], ["b"]):
        for nulls in ("zero", "skip"):
            old, new = derive.row_stats(derive.n_array(cols, nulls)), derive.column_stats(cols, nulls)
            assert df.select(*[v.alias(k) for k, v in old.items()]).collect() == df.select(*[v.alias(k) for k, v in new.items()]).collect()


def test_long_methods_are_not_generated(spark, tmp_path):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    for t, schema in {
        "lineitem": "l_orderkey long, l_extendedprice double, l_linenumber int, l_discount double, l_tax double, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double",
        "orders": "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string",
        "customer": "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int", "part": "p_partkey long, p_size int, p_retailprice double",
    }.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    loans.load_loans(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_the_known_auc_is_not_computed_again(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("oof", i, i % 2, *[0.5 + 0.1 * (i % 2 - 0.5) * (j + 1) + rng.gauss(0, 0.2) for j in range(3)]) for i in range(200)]
    runs = ["r0", "r1", "r2"]
    wide = spark.createDataFrame(rows, "split string, id long, y int, r0 double, r1 double, r2 double")
    start = (0.0, 0.5, 0.5)
    auc = blend.grid_auc(wide, runs, [start]).first()["auc"]
    asked, search = [], blend.grid_auc
    monkeypatch.setattr(blend, "grid_auc", lambda wide, runs, weights, *more: asked.append(list(weights)) or search(wide, runs, weights, *more))
    blend.gradient_weights(wide, runs, start, rounds=1, start_auc=auc)
    assert len(asked) == 1 and start not in asked[0]
    assert search(wide, runs, [start], "oof", 1.0).count() == 0  # nothing is above
