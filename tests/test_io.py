"""Feature-table I/O, metadata, cache-or-build, required columns, model reload."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskframe.session import checkpoint_dir
from riskframe.sources import io


def _tmp(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def test_write_and_load_feature_table(spark):
    df = spark.createDataFrame([(1, 1, 0, 2.5, "a"), (2, 0, None, 1.5, "b")],
                               "id long, is_train int, isDefault int, x double, c string")
    path = _tmp(spark)
    meta = io.write_feature_table(df, path, ["x", "c"], ["c"])
    assert meta["n_train"] == 1 and meta["n_test"] == 1
    train, test, feats, cats, meta2 = io.load_feature_table(spark, path)
    assert feats == ["x", "c"] and cats == ["c"] and "isDefault" not in test.columns
    assert train.count() == 1 and test.count() == 1


def test_cache_or_build_rebuilds_once(spark):
    from riskframe.plans.features import FeatureTable

    calls = []

    def build():
        calls.append(1)
        df = spark.createDataFrame([(1, 1, 0, 2.0)], "id long, is_train int, isDefault int, x double")
        return FeatureTable(df, ["x"], [], {})

    path = _tmp(spark)
    s1, _ = io.cache_or_build(spark, path, build)
    s2, _ = io.cache_or_build(spark, path, build)
    assert s1["built"] and not s2["built"] and len(calls) == 1


def test_require_columns_lists_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError, match="missing feature columns"):
        io.require_columns(df, ["a"] + [f"m{i}" for i in range(12)])


def test_typed_reload_and_types(spark):
    from riskframe.operators import stats

    df = spark.createDataFrame([("1.5", "x"), ("bad", "y")], "v string, c string")
    out = io.typed_reload(df, {"features": ["v", "c"], "cat_features": ["c"]})
    assert [r["v"] for r in out.collect()] == [1.5, None]
    ints = spark.createDataFrame([(1, 300), (2, 5)], "a long, b long")
    prof = stats.type_profile(ints)
    typed = io.apply_types(ints, prof)
    assert dict(typed.dtypes) == {"a": "tinyint", "b": "smallint"}


def test_reports_and_sidecars(spark):
    out = _tmp(spark)
    rep = {"missing": spark.createDataFrame([("a", 0.5)], "col string, nan_ratio double")}
    text = io.write_reports(rep, out)
    assert "missing" in text and io.path_exists(spark, out + "/summary.md")
    io.write_sidecar_lists(spark, out, features=["a", "b"], cat_features=[])
    assert io.read_text(spark, out + "/features.txt") == "a\nb\n"


def test_saved_fold_models_rescore(spark):
    from riskframe.operators import train as tr

    rows = [(i, int(i % 3 == 0), float(i % 7), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, isDefault int, a double, b double")
    test = spark.createDataFrame([(1000 + i, float(i % 7), float(i % 5)) for i in range(10)], "id long, a double, b double")
    path = _tmp(spark)
    res = tr.train_cv(df, test, ["a", "b"], [], tr.with_overrides(tr.CONFIGS["LR"], n_folds=3), model_dir=path)
    again = {r["id"]: r["pred"] for r in tr.rescore(test, path, "lr", 3).collect()}
    first = {r["id"]: r["pred"] for r in res.predictions.filter(F.col("split") == "sub").collect()}
    assert all(abs(again[i] - first[i]) < 1e-9 for i in first)


def _table(spark, value):
    from riskframe.plans.features import FeatureTable

    df = spark.createDataFrame([(1, 1, 0, float(value)), (2, 0, None, 3.0)], "id long, is_train int, isDefault int, x double")
    return FeatureTable(df, ["x"], [], {})


def _cache(spark, path, value, inputs=None, settings=None):
    built = []

    def build():
        built.append(value)
        return _table(spark, value)

    status, (train, *_) = io.cache_or_build(spark, path, build, inputs, settings)
    assert status["built"] == bool(built)
    return train.first()["x"]


def test_cache_follows_input_files_and_settings(spark):
    path, data = _tmp(spark), _tmp(spark)
    spark.range(5).write.parquet(data + "/in")
    assert _cache(spark, path, 1, [data], {"v": "v1"}) == 1
    assert _cache(spark, path, 2, [data], {"v": "v1"}) == 1  # nothing has changed
    assert _cache(spark, path, 3, [data], {"v": "v3"}) == 3  # other settings
    spark.range(3).write.mode("append").parquet(data + "/in")
    assert _cache(spark, path, 4, [data], {"v": "v1"}) == 4  # a file more
    assert _cache(spark, path, 5, [data], {"v": "v1"}) == 4
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        _cache(spark, path, 6, [data + "/none"])
    now = io.cache_key(io.input_files(spark, [data]), {"v": "v1"})
    assert len(io.prune_cache(spark, path, [now])) == 2
    assert len(io.list_names(spark, path + "/tables")) == 1 and _cache(spark, path, 7, [data], {"v": "v1"}) == 4


def test_cache_crash_before_commit_and_damage(spark, monkeypatch):
    path = _tmp(spark)
    with monkeypatch.context() as m:
        m.setattr(io, "write_text_atomically", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            _cache(spark, path, 1)
    assert len(io.list_names(spark, path + "/tables")) == 1  # whole or not: without a manifest nobody reads it
    assert _cache(spark, path, 2) == 2
    manifest = f"{path}/manifests/{io.cache_key([], None)}.json"
    folder = io.json.loads(io.read_text(spark, manifest))["folder"]
    io.remove_path(spark, f"{path}/tables/{folder}/meta.json")
    assert _cache(spark, path, 3) == 3  # the table isn't whole any more
    folder = io.json.loads(io.read_text(spark, manifest))["folder"]
    io.remove_path(spark, f"{path}/tables/{folder}/data")
    spark.createDataFrame([(1, 1)], "id int, is_train int").write.partitionBy("is_train").parquet(f"{path}/tables/{folder}/data")
    assert _cache(spark, path, 4) == 4  # another schema than written
    io.remove_path(spark, manifest)
    io.write_text(spark, manifest, "{broken")
    with pytest.raises(ValueError):  # an unreadable manifest is an error, not a reason to overwrite
        _cache(spark, path, 5)


def test_cache_two_writers(spark):
    path, inner = _tmp(spark), []

    def build():  # another writer comes through while this one builds
        if not inner:
            inner.append(None)
            inner.append(io.cache_or_build(spark, path, lambda: _table(spark, 1))[1][0].first()["x"])
        return _table(spark, 2)

    _, (train, *_) = io.cache_or_build(spark, path, build)
    assert inner[1] == 1 and train.first()["x"] == 1 and _cache(spark, path, 3) == 1
    assert len(io.list_names(spark, path + "/tables")) == 1


def test_file_uri_roots(spark):
    path = "file:" + _tmp(spark).removeprefix("file:")
    df = spark.createDataFrame([(1, 1, 0, 2.0), (2, 0, None, 3.0)], "id long, is_train int, isDefault int, x double")
    meta = io.write_feature_table(df, path, ["x"], [])
    train, test, features, cats, again = io.load_feature_table(spark, path)
    assert (meta["n_train"], meta["n_test"]) == (1, 1) and features == ["x"] and cats == [] and again == meta
    assert train.count() == 1 and test.columns == ["id", "x"]


def test_reports_list_rows_in_order(spark):
    rep = {"r": spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "col string, v double")}
    text = io.write_reports(rep, _tmp(spark), top=2, order={"r": [F.desc("v")]})
    assert "| b | 0.9 |" in text and "| c | 0.5 |" in text and "| a |" not in text


def test_shared_folder_is_required_off_local_machines():
    from types import SimpleNamespace as N

    from riskframe import session

    conf = N(get=lambda *a: None)
    sc = N(master="spark://host:7077", getConf=lambda: conf, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(N(sparkContext=sc))
    with pytest.raises(ValueError):
        session.get_session(master="yarn")
