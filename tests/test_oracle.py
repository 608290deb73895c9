"""Spark queries against their DuckDB oracle on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
KEYS = ["past_rate", "parse_dates", "row_stats", "vintage_rank", "kfold_target_encode",
        "time_block_target_encode", "woe_bad_good", "auc", "monthly_auc", "audit_past_rate",
        "blend_rank_mean", "stratified_folds"]
# The feature-table oracles fix the set of downgraded high-cardinality
# categories as it is at sf0.01, so they are checked there.
SF_FEATURES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    from check_oracle import duck as make

    return make(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    import __spark_entry__ as entry
    from check_oracle import digest

    sdf = entry.queries()[key](spark, SF)
    res = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("key", ["features_v3"])
def test_feature_table_matches_oracle(spark, key):
    import __spark_entry__ as entry
    from check_oracle import digest, duck as make

    con = make(SF_FEATURES)
    sdf = entry.queries()[key](spark, SF_FEATURES)
    res = con.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_key_has_an_entry_and_oracle_names_exist():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 80


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
