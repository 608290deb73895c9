"""Plan shape: pruning reaches the scan, rank metrics avoid a single partition."""

from riskframe.operators import metrics


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruned_scan_reads_two_columns(spark):
    import __spark_entry__ as entry

    df = entry.queries()["scan_pruned"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    schemas = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line]
    assert schemas, plan
    read = " ".join(schemas)
    # only keys and the return flag are read; prices, dates and names never leave the files
    for col in ("l_extendedprice", "l_shipdate", "o_totalprice", "c_name", "p_name"):
        assert col not in read


def test_grouped_auc_has_no_single_partition_exchange(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "CAST(id % 2 AS INT) AS y", "rand(1) AS s")
    plan = _plan(metrics.auc(df, "s", "y", by=["g"]))
    assert "SinglePartition" not in plan
