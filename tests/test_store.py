"""Bucketed prediction store: no exchange when runs are aligned, same rows as the long table's align."""

import uuid

import pytest
from pyspark.sql import functions as F

from riskframe.operators import blend
from riskframe.session import checkpoint_dir
from riskframe.sources import store


def put(spark, runs, buckets=4):
    path = f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    for run, rows in runs.items():
        store.write_run(spark.createDataFrame(rows, "split string, id long, y int, pred double"), path, run, buckets)
    return path


def sample(skip):
    return [("oof", k, k % 2, k / 7 + skip) for k in range(40) if k % 9 != skip] + [("sub", k, None, k / 3) for k in range(40, 60)]


def test_align_has_no_exchange_and_equals_the_long_way(spark):
    data = {f"r{k}": sample(k) for k in range(5)}
    path = put(spark, data)
    rows = [("oof", k, k % 5) for k in range(40)]
    store.write_folds(spark.createDataFrame(rows, "split string, id long, fold int"), path)
    wide = store.align(spark, path, folds=True)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 5
    long = None
    for run, held in data.items():
        df = spark.createDataFrame(held, "split string, id long, y int, pred double").withColumn("run", F.lit(run))
        long = df if long is None else long.unionByName(df)
    key = lambda r: (r[0], r[1])
    want = sorted(map(tuple, blend.align(long, list(data)).collect()), key=key)
    got = sorted(map(tuple, wide.drop("fold").collect()), key=key)
    assert got == want and len(got) == 36  # 16 of the 40 oof ids are in all runs, and 20 sub
    assert all(r.fold == (r.id % 5 if r.split == "oof" else None) for r in wide.collect())


def test_a_new_session_finds_the_tables_and_a_run_is_replaced(spark):
    path = put(spark, {"a": sample(0), "b": sample(1)})
    store.write_run(spark.createDataFrame([("oof", 1, 1, 0.25)], "split string, id long, y int, pred double"), path, "b", 99)
    other = spark.newSession()
    for t in other.catalog.listTables():
        if t.name.startswith("store_"):
            other.sql(f"DROP TABLE {t.name}")  # external: the files stay
    assert store.runs(other, path) == ["a", "b"]
    got = store.align(other, path)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("oof", 1, 1, 1 / 7, 0.25)]


def test_repeated_ids_differing_targets_and_missing_runs_raise(spark):
    twice = put(spark, {"a": [("oof", 1, 1, 0.5), ("oof", 1, 1, 0.5)]})
    with pytest.raises(Exception, match="repeated"):
        store.align(spark, twice).collect()
    differ = put(spark, {"a": [("oof", 1, 1, 0.5)], "b": [("oof", 1, 0, 0.5)]})
    with pytest.raises(Exception, match="differs"):
        store.align(spark, differ).collect()
    with pytest.raises(FileNotFoundError):
        store.align(spark, differ, ["c"])
    assert store.runs(spark, differ + "-none") == []
