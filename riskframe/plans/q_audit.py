"""Queries for the audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import audit, encode
from riskframe.plans.catalog import query
from riskframe.plans.common import materialize, rnd
from riskframe.plans.q_encode import BLOCK_TE_COLS, PAST_RATE_KEYS, WOE_V3_COLS, encoder_base, feature_base
from riskframe.sources.loans import load_loans, split_train_test
from riskframe.sources.predictions import RUNS, score_wide


def _train(spark, sf_dir):
    train, _ = split_train_test(load_loans(spark, sf_dir))
    return train


@query("basic_profile")
def q_basic_profile(spark, sf_dir):
    """A1 shape, type counts and positive rate of the train table."""
    p = audit.basic_profile(_train(spark, sf_dir), "isDefault")
    return p.select("n_rows", "n_cols", "n_num", "n_str", rnd("target_pos_rate").alias("target_pos_rate"))


def _missing(spark, sf_dir):
    t = _train(spark, sf_dir)
    return audit.missing_inf(t, audit.numeric_cols(t))


@query("missing_ratio")
def q_missing_ratio(spark, sf_dir):
    """A6/G6 null ratio per numeric column of the train table."""
    return _missing(spark, sf_dir).select("col", rnd("nan_ratio").alias("nan_ratio"))


@query("inf_counts")
def q_inf_counts(spark, sf_dir):
    """A6/G6 ±inf count per numeric column of the train table."""
    return _missing(spark, sf_dir).select("col", "n_inf")


@query("top_missing")
def q_top_missing(spark, sf_dir):
    """T2 the five columns with the highest null ratio."""
    m = _missing(spark, sf_dir)
    return m.orderBy(F.desc("nan_ratio"), "col").limit(5).select("col", rnd("nan_ratio").alias("nan_ratio"))


@query("woe_summary")
def q_woe_summary(spark, sf_dir):
    """A2 health and single-column AUC of the WOE columns on train rows."""
    base = feature_base(spark, sf_dir, crosses=False).select("id", "is_train", "isDefault", *WOE_V3_COLS)
    df = base
    models = encode.fit_woe_multi(base, WOE_V3_COLS, q=10, style="bad_good")
    for c in WOE_V3_COLS:
        df = encode.apply_woe(df, models[c], c)
    train = df.filter("is_train = 1")
    s = audit.woe_summary(train, "isDefault", [f"woe_{c}" for c in WOE_V3_COLS])
    return s.select("col", rnd("nan_ratio").alias("nan_ratio"), "n_inf", rnd("mean").alias("mean"),
                    rnd("std").alias("std"), rnd("auc_vs_target").alias("auc_vs_target"))


def _te_train(spark, sf_dir):
    fb = feature_base(spark, sf_dir).select("id", "is_train", "isDefault", "time_key", *BLOCK_TE_COLS)
    blocks = materialize(encode.fit_time_blocks(fb, n_blocks=5, min_train_gap=1))
    df = encode.block_target_encode(fb, BLOCK_TE_COLS, blocks=blocks)
    return materialize(df.filter("is_train = 1"))


@query("audit_te")
def q_audit_te(spark, sf_dir):
    """A3 month-by-month past-only recomputation of the block target means."""
    r = audit.audit_time_aware_te(_te_train(spark, sf_dir), "isDefault", "time_key")
    return r.select("te_col", rnd("mae").alias("mae"), rnd("rmse").alias("rmse"), "check_months", "rows_compared")


@query("audit_flags")
def q_audit_flags(spark, sf_dir):
    """A7 target-encoded columns whose recomputation differs (MAE > 1e-6), worst five."""
    r = audit.audit_time_aware_te(_te_train(spark, sf_dir), "isDefault", "time_key")
    return audit.audit_flags(r).select("te_col", rnd("mae").alias("mae"), "rows_compared")


@query("audit_past_rate")
def q_audit_past_rate(spark, sf_dir):
    """A4 recomputation of the past default rates on train rows (must be 0)."""
    df = encode.past_rate(encoder_base(spark, sf_dir), PAST_RATE_KEYS)
    r = audit.audit_past_rate(materialize(df.filter("is_train = 1")), "isDefault", "time_key")
    return r.select("hist_col", "key_col", rnd("mae").alias("mae"), rnd("rmse").alias("rmse"), "rows_compared")


@query("monthly_auc")
def q_monthly_auc(spark, sf_dir):
    """A5 AUC of every score column in every month of the train rows."""
    wide = materialize(score_wide(spark, sf_dir).filter("is_train = 1"))
    r = audit.monthly_auc(wide, "isDefault", RUNS, "time_key")
    return r.select("time_key", "col", rnd("auc").alias("auc"), "n")


@query("last_n_months")
def q_last_n_months(spark, sf_dir):
    """P11 loans of the 12 latest issue months."""
    df = encoder_base(spark, sf_dir).select("id", "time_key")
    return audit.last_n_months(df, "time_key", 12)
