"""Encoders: the FIXTURES §5 cases, pandas brute force, leakage properties."""

import random

import pandas as pd
from pyspark.sql import functions as F

from riskframe.operators import encode

SCHEMA = "id long, is_train int, isDefault int, time_key int, k string"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_past_rate_lags_within_key(spark):
    # key a has months 1 and 2; key b starts at month 2
    rows = [(1, 1, 1, 1, "a"), (2, 1, 0, 1, "a"), (3, 1, 1, 2, "a"), (4, 1, 0, 2, "b"), (5, 1, 1, 2, "b"),
            (6, 0, None, 3, "a"), (7, 0, None, 3, "c")]
    out = {r["id"]: r["hist_rate_k"] for r in encode.past_rate(_df(spark, rows), "k").collect()}
    glob = 3 / 5
    assert out[1] == glob and out[2] == glob          # a's first month: no past
    assert out[3] == 0.5                              # a at month 2 = a's month-1 rate
    assert out[4] == glob and out[5] == glob          # b at month 2: global, never a's totals
    assert out[6] == 0.5                              # test row: a's train months before the last (2)
    assert out[7] == glob                             # unseen key


def _pandas_block_te(pdf, n_blocks=5):
    tr = pdf[pdf.is_train == 1]
    months = sorted(tr.loc[tr.time_key > 0, "time_key"].unique())
    k = n_blocks if len(months) >= n_blocks else max(2, len(months))
    import numpy as np

    blocks = np.array_split(np.array(months), k)
    prior = tr.isDefault.mean()
    out = {}
    for b in blocks:
        past = [m for m in months if m < b[0]]
        if not past:
            continue
        hist = tr[tr.time_key.isin(past)].groupby("k").isDefault.mean()
        for _, r in tr[tr.time_key.isin(list(b))].iterrows():
            out[r.id] = hist.get(r.k, prior)
    full = tr.groupby("k").isDefault.mean()
    for _, r in pdf[pdf.is_train == 0].iterrows():
        out[r.id] = full.get(r.k, prior)
    return out


def test_block_te_matches_brute_force_and_ignores_row_order(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        rows.append((i, int(rnd.random() < 0.8), rnd.randint(0, 1), 201500 + rnd.randint(1, 12), rnd.choice("abcde")))
    rows = [(i, t, y if t else None, m, k) for i, t, y, m, k in rows]
    expect = _pandas_block_te(pd.DataFrame(rows, columns=["id", "is_train", "isDefault", "time_key", "k"]))
    for order in (rows, list(reversed(rows))):
        got = {r["id"]: r["te_k"] for r in encode.block_target_encode(_df(spark, order), "k").collect()}
        for i, v in expect.items():
            assert abs(got[i] - v) < 1e-12
        first_block = [i for i, t, y, m, k in rows if t == 1 and i not in expect]
        assert all(got[i] is None for i in first_block)


def test_kfold_te_single_fold_key_gets_prior(spark):
    rows = [(i, 1, i % 2, 1, "common") for i in range(50)] + [(1000, 1, 1, 1, "lonely")]
    df = _df(spark, rows)
    out = {r["id"]: r["te_k"] for r in encode.kfold_target_encode(df, "k", m=50.0).collect()}
    prior = (25 + 1) / 51
    assert abs(out[1000] - prior) < 1e-12


def _swap_labels(rows, a, b):
    """Swap the targets of rows a and b (keeps every total, hence the prior)."""
    ya = next(r[2] for r in rows if r[0] == a)
    yb = next(r[2] for r in rows if r[0] == b)
    return [(i, t, yb if i == a else ya if i == b else y, m, k) for i, t, y, m, k in rows]


def test_kfold_te_own_fold_labels_do_not_leak(spark):
    rows = [(i, 1, int(i % 3 == 0), 1, "abc"[i % 7 % 3]) for i in range(120)]
    df = _df(spark, rows)
    fold = {r["id"]: r["f"] for r in df.select("id", encode.hash_fold(F.col("id"), 5).alias("f")).collect()}
    base = {r["id"]: r["te_k"] for r in encode.kfold_target_encode(df, "k").collect()}
    f0 = fold[0]
    same = [i for i in range(120) if fold[i] == f0]
    a = next(i for i in same if rows[i][2] == 1)
    b = next(i for i in same if rows[i][2] == 0)
    after = {r["id"]: r["te_k"] for r in encode.kfold_target_encode(_df(spark, _swap_labels(rows, a, b)), "k").collect()}
    for i in same:  # every row of that fold is encoded from the other folds only
        assert abs(base[i] - after[i]) < 1e-12


def test_past_rate_same_and_later_months_do_not_leak(spark):
    rows = [(i, 1, i % 2, 201500 + (i % 6) + 1, "ab"[i % 4 // 2]) for i in range(120)]
    base = {r["id"]: r["hist_rate_k"] for r in encode.past_rate(_df(spark, rows), "k").collect()}
    late = [r for r in rows if r[3] >= 201504]
    a = next(r[0] for r in late if r[2] == 1)
    b = next(r[0] for r in late if r[2] == 0)
    after = {r["id"]: r["hist_rate_k"] for r in encode.past_rate(_df(spark, _swap_labels(rows, a, b)), "k").collect()}
    for i, t, y, m, k in rows:
        if m <= 201504:  # sees months < 201504 only
            assert abs(base[i] - after[i]) < 1e-12


def test_block_te_later_blocks_do_not_leak(spark):
    rows = [(i, 1, i % 2, 201500 + (i % 10) + 1, "ab"[i % 4 // 2]) for i in range(200)]
    base = {r["id"]: r["te_k"] for r in encode.block_target_encode(_df(spark, rows), "k").collect()}
    last = [r for r in rows if r[3] >= 201509]  # the last block (months 9, 10)
    a = next(r[0] for r in last if r[2] == 1)
    b = next(r[0] for r in last if r[2] == 0)
    after = {r["id"]: r["te_k"] for r in encode.block_target_encode(_df(spark, _swap_labels(rows, a, b)), "k").collect()}
    for i, t, y, m, k in rows:
        assert base[i] == after[i] or abs(base[i] - after[i]) < 1e-12


def test_woe_constant_and_out_of_range(spark):
    rows = [(i, 1, i % 2, 1, None) for i in range(40)]
    df = spark.createDataFrame([(i, t, y, float(5)) for i, t, y, _, _ in rows], "id long, is_train int, isDefault int, x double")
    assert {r["woe_x"] for r in encode.woe_encode(df, "x", style="bad_good").collect()} == {0.0}
    df2 = spark.createDataFrame(
        [(i, 1, i % 2, float(i)) for i in range(40)] + [(100, 0, None, 1000.0), (101, 0, None, None)],
        "id long, is_train int, isDefault int, x double")
    for style in ("good_bad", "bad_good"):
        out = {r["id"]: r["woe_x"] for r in encode.woe_encode(df2, "x", style=style).collect()}
        assert out[100] == 0.0 and out[101] == 0.0


def test_quantile_bins_match_pandas_qcut(spark):
    vals = [float(v) for v in [1, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 55, 55]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in encode.quantile_bin(df, "x", 4, "b").select("b").collect()]
    expect = pd.qcut(pd.Series(vals), 4, duplicates="drop", labels=False).tolist()
    assert got == expect


def test_freq_encode_null_is_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    from collections import Counter

    out = Counter((r["k"], r["k_freq"]) for r in encode.freq_encode(df, ["k"]).collect())
    assert out == Counter([("a", 0.5), ("a", 0.5), (None, 0.25), ("b", 0.25)])


def test_high_cardinality_exact_at_the_threshold(spark):
    rows = [(f"k{i % 201}", f"j{i % 199}", None if i % 7 == 0 else f"n{i % 200}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    # a: 201 values, b: 199, c: 200 values + null = 201
    assert encode.high_cardinality_columns(df, ["a", "b", "c"], 200) == ["a", "c"]


def test_time_blocks_follow_array_split(spark):
    import numpy as np

    for n_months, n_blocks, gap in ((13, 5, 1), (3, 5, 1), (10, 4, 3)):
        rows = [(i, 1, 0, 201500 + 1 + i % n_months, "a") for i in range(5 * n_months)]
        rows.append((999, 1, 0, 0, "a"))  # an unparsable month never forms a block
        got = {r["month"]: (r["block"], r["valid"]) for r in encode.fit_time_blocks(
            _df(spark, rows), n_blocks=n_blocks, min_train_gap=gap).collect()}
        months = sorted({r[3] for r in rows if r[3] > 0})
        k = n_blocks if len(months) >= n_blocks else max(2, len(months))
        seen = 0
        for b, part in enumerate(np.array_split(np.array(months), k), start=1):
            for m in part:
                assert got[int(m)] == (b, seen >= gap)
            seen += len(part)
        assert 0 not in got


def test_one_lookup_per_key_column_equals_separate_lookups(spark):
    import random

    rng = random.Random(11)
    rows = [(i, int(rng.random() < 0.8), rng.randint(0, 1), 202000 + rng.randint(1, 9), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, is_train int, isDefault int, time_key int, k string, c int")
    df = df.withColumn("isDefault", F.when(F.col("is_train") == 1, F.col("isDefault")))
    keys = ["k", "c"]
    freq, counts, past = encode.fit_freq(df, keys), encode.fit_train_count(df, keys), encode.fit_past_rate(df, keys)
    blocks = encode.fit_time_blocks(df)
    kfold, block = encode.fit_kfold_te(df, keys), encode.fit_block_te(df, keys, blocks=blocks)
    base = encode.with_blocks(df, blocks)
    for te, apart in ((kfold, encode.apply_kfold_te), (block, encode.apply_block_te)):
        table = encode.combine_fits(counts=counts, te=te, past=past)
        one, many = base, base
        for c in keys:
            one = encode.apply_fits(one, table, c, cnt=f"{c}_n", te=te, past=past)
            many = encode.apply_past_rate(apart(encode.apply_train_count(many, counts, c, f"{c}_n"), te, c), past, c)
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == len(keys) + 1  # a join per key column, and the months' blocks
        cols = ["id", *[f for c in keys for f in (f"{c}_n", f"te_{c}", f"hist_rate_{c}")]]
        left, right = ([tuple(r) for r in d.select(*cols).orderBy("id").collect()] for d in (one, many))
        assert left == right
    only = encode.combine_fits(freq=freq)
    got = encode.apply_fits(df.filter("k is not null"), only, "k", freq="k_freq").select("id", "k_freq").orderBy("id").collect()
    assert got == encode.apply_freq(df.filter("k is not null"), freq, "k").select("id", "k_freq").orderBy("id").collect()
