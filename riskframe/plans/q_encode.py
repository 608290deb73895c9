"""Queries for the encoders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.functions import parse
from riskframe.operators import encode
from riskframe.plans.catalog import query
from riskframe.plans.common import materialize, rnd, with_time_columns
from riskframe.session import checkpoint_dir
from riskframe.sources.loans import load_loans, supervised_view
from riskframe.streaming import past_state

PAST_RATE_KEYS = ["regionCode", "grade", "purpose", "postCode_cat"]


def encoder_base(spark, sf_dir, extra=()):
    """Supervised loan view with month key and post-code category, written once."""
    loans = supervised_view(load_loans(spark, sf_dir))
    df = with_time_columns(loans).withColumn(
        "postCode_cat", parse.postcode3(F.col("postCode"), loans.schema["postCode"].dataType)
    )
    cols = ["id", "is_train", "isDefault", "time_key", "regionCode", "grade", "purpose",
            "postCode_cat", *extra]
    return materialize(df.select(*dict.fromkeys(cols)))


@query("past_rate")
def q_past_rate(spark, sf_dir):
    """E6: each loan's key default rate over strictly earlier months."""
    df = encode.past_rate(encoder_base(spark, sf_dir), PAST_RATE_KEYS)
    return df.select(
        "id", "time_key", *[rnd(f"hist_rate_{k}").alias(f"hist_rate_{k}") for k in PAST_RATE_KEYS]
    )


# ---------------------------------------------------------------- shared base


def feature_base(spark, sf_dir, crosses: bool = True):
    """Parsed loans with category copies (and crosses), written once per query."""
    from riskframe.plans.q_parse import cross_columns, parsed

    loans = supervised_view(load_loans(spark, sf_dir))
    df = materialize(parsed(loans))
    df = df.withColumns({
        f"{c}_cat": parse.category_copy(F.col(c))
        for c in ("employmentTitle", "title", "issueDate", "earliesCreditLine")
    })
    if crosses:
        df = cross_columns(df)
    return materialize(df)


FREQ_COLS = {"employmentTitle_cat": "employmentTitle_freq", "title_cat": "title_freq",
             "postCode_cat": "postCode_freq"}
CROSSES = ["grade_term", "fico_dti", "purpose_home", "iy_region"]
KFOLD_TE_COLS = ["employmentTitle_cat", "title_cat", "postCode_cat", "subGrade",
                 "issueDate_cat", "earliesCreditLine_cat"]
BLOCK_TE_COLS = ["grade_term", "fico_dti", "purpose_home", "iy_region", "subGrade",
                 "employmentLength_cat", "postCode_cat"]
WOE_V2_COLS = ["fico_mean", "credit_hist_mon", "interestRate", "dti", "revolUtil"]
WOE_V3_COLS = ["credit_hist_mon", "revolUtil", "dti"]
CAT_COLS_V1 = ["term_bin", "employmentLength_cat", "issueDate_cat", "earliesCreditLine_cat",
               "employmentTitle_cat", "title_cat", "postCode_cat", "grade", "subGrade",
               "homeOwnership", "purpose", "regionCode", "policyCode"]


@query("freq_encode")
def q_freq_encode(spark, sf_dir):
    """E1 share of each value over train + test (null is a value)."""
    df = feature_base(spark, sf_dir, crosses=False).select("id", *FREQ_COLS)
    table = encode.fit_freq(df, list(FREQ_COLS))
    for c, out in FREQ_COLS.items():
        df = encode.apply_freq(df, table, c, out)
    return df.select("id", *[rnd(o).alias(o) for o in FREQ_COLS.values()])


@query("train_count_encode")
def q_train_count(spark, sf_dir):
    """E2 count of train rows per cross value; unseen → 0."""
    df = feature_base(spark, sf_dir).select("id", "is_train", *CROSSES)
    counts = encode.fit_train_count(df, CROSSES)
    for c in CROSSES:
        df = encode.apply_train_count(df, counts, c, f"{c}_freq")
    return df.select("id", *[f"{c}_freq" for c in CROSSES])


@query("kfold_target_encode")
def q_kfold_te(spark, sf_dir):
    """E3 out-of-fold smoothed target mean (k=5, m=50) for the v2 columns."""
    df = feature_base(spark, sf_dir, crosses=False).select("id", "is_train", "isDefault", *KFOLD_TE_COLS)
    df = encode.kfold_target_encode(df, KFOLD_TE_COLS, k=5, m=50.0)
    return df.select("id", *[rnd(f"te_{c}").alias(f"te_{c}") for c in KFOLD_TE_COLS])


@query("time_blocks")
def q_time_blocks(spark, sf_dir):
    """E4 contiguous month blocks of the train months."""
    return encode.fit_time_blocks(encoder_base(spark, sf_dir), n_blocks=5, min_train_gap=1)


@query("time_block_target_encode")
def q_block_te(spark, sf_dir):
    """E5 past-blocks-only target mean for the v3 columns."""
    df = feature_base(spark, sf_dir).select("id", "is_train", "isDefault", "time_key", *BLOCK_TE_COLS)
    blocks = materialize(encode.fit_time_blocks(df, n_blocks=5, min_train_gap=1))
    df = encode.block_target_encode(df, BLOCK_TE_COLS, blocks=blocks)
    return df.select("id", "time_key", *[rnd(f"te_{c}").alias(f"te_{c}") for c in BLOCK_TE_COLS])


@query("past_rate_test")
def q_past_rate_test(spark, sf_dir):
    """E6/W3 the rate each key hands to test rows (train months before the last)."""
    return _test_rates(encode.fit_past_rate(encoder_base(spark, sf_dir), PAST_RATE_KEYS))


@query("past_rate_stream")
def q_past_rate_stream(spark, sf_dir):
    """E6 the same rates, kept by a stream that is fed the loans in eight files, in no order of time."""
    base = encoder_base(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/past-state-{uuid.uuid4().hex}"
    base.repartition(8, F.md5(F.col("id").cast("string"))).write.parquet(f"{root}/loans")
    arriving = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/loans")
    past_state.start(arriving, PAST_RATE_KEYS, f"{root}/rates", available_now=True).awaitTermination()
    return _test_rates(past_state.fitted(spark, f"{root}/rates", PAST_RATE_KEYS))


def _test_rates(model):
    fallback = F.create_map(*[x for k, v in model.global_rate.items() for x in (F.lit(k), F.lit(v))])
    return model.table.filter(F.col("month") == -1).select(
        F.col("col").alias("key_col"), "key",
        rnd(F.coalesce(F.col("rate"), fallback[F.col("col")])).alias("rate"),
    )


def _woe_query(spark, sf_dir, cols, style):
    df = feature_base(spark, sf_dir, crosses=False).select("id", "is_train", "isDefault", *cols)
    models = encode.fit_woe_multi(df, cols, q=10, style=style)
    for c in cols:
        df = encode.apply_woe(df, models[c], c)
    return df.select("id", *[rnd(f"woe_{c}").alias(f"woe_{c}") for c in cols])


@query("woe_good_bad")
def q_woe_good_bad(spark, sf_dir):
    """E8 WOE over train deciles, ln(good share / bad share) (version 2)."""
    return _woe_query(spark, sf_dir, WOE_V2_COLS, "good_bad")


@query("woe_bad_good")
def q_woe_bad_good(spark, sf_dir):
    """E9 WOE over train deciles, ln(bad share / good share) (version 3)."""
    return _woe_query(spark, sf_dir, WOE_V3_COLS, "bad_good")


@query("cardinality")
def q_cardinality(spark, sf_dir):
    """G4 distinct values per category column, null counted as a value."""
    df = feature_base(spark, sf_dir, crosses=False)
    return encode.cardinality(df, CAT_COLS_V1)


@query("cardinality_downgrade")
def q_cardinality_downgrade(spark, sf_dir):
    """E10 categories above 200 distinct values leave the categorical list."""
    card = q_cardinality(spark, sf_dir)
    return card.withColumn("downgraded", F.col("nunique") > 200)


@query("target_join")
def q_target_join(spark, sf_dir):
    """J2 left join of the target onto a feature table by id."""
    feats = feature_base(spark, sf_dir).select("id", "time_key", "grade_term")
    target = load_loans(spark, sf_dir).select("id", "isDefault")
    return feats.join(target, "id", "left")
