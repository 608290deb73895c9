"""Oracle SQL for the encoder queries."""

from __future__ import annotations

from oracle import base as b
from oracle.base import r
from oracle.queries import register

PAST_RATE_KEYS = ["regionCode", "grade", "purpose", "postCode_cat"]

ENC_BASE = f"""
enc_base AS (
  SELECT id, is_train, isDefault, regionCode, grade, purpose, n0, n4,
         {b.postcode3('postCode')} AS postCode_cat,
         {b.time_key(b.parse_date('issueDate'))} AS time_key
  FROM sup
)"""


def past_rate_ctes(key: str, src: str = "enc_base") -> str:
    """CTEs pr_<key>_g (key, month sums), pr_<key> (lookup), pr_<key>_gr (global)."""
    return f"""
pr_{key}_g AS (
  SELECT {key} AS k, time_key AS m, CAST(sum(isDefault) AS DOUBLE) AS s, count(*) AS n
  FROM {src} WHERE is_train = 1 AND {key} IS NOT NULL GROUP BY 1, 2
),
pr_{key}_gr AS (SELECT sum(s) / sum(n) AS gr FROM pr_{key}_g),
pr_{key} AS (
  SELECT k, m, sum(s) OVER w / sum(n) OVER w AS rate FROM pr_{key}_g
  WINDOW w AS (PARTITION BY k ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT k, -1 AS m, sum(s) / sum(n) AS rate FROM pr_{key}_g
  WHERE m < (SELECT max(m) FROM pr_{key}_g) GROUP BY k
)"""


def past_rate_join(key: str, alias: str, src_alias: str = "e") -> str:
    return (
        f"LEFT JOIN pr_{key} {alias} ON {src_alias}.{key} = {alias}.k AND "
        f"(CASE WHEN {src_alias}.is_train = 1 THEN {src_alias}.time_key ELSE -1 END) = {alias}.m"
    )


def past_rate_value(key: str, alias: str) -> str:
    return f"coalesce({alias}.rate, (SELECT gr FROM pr_{key}_gr))"


register(
    "past_rate",
    "WITH " + ENC_BASE + "," + ",".join(past_rate_ctes(k) for k in PAST_RATE_KEYS) + "\n"
    "SELECT e.id, e.time_key, "
    + ", ".join(f"{r(past_rate_value(k, f't{i}'))} AS hist_rate_{k}" for i, k in enumerate(PAST_RATE_KEYS))
    + "\nFROM enc_base e "
    + " ".join(past_rate_join(k, f"t{i}") for i, k in enumerate(PAST_RATE_KEYS)),
)


# ---------------------------------------------------------------- feature base

from oracle.q_parse import CROSSES as CROSS_CTE  # noqa: E402
from oracle.q_parse import QBINS, bin_index, qbin_edges, with_parsed  # noqa: E402

FB_CTE = (
    QBINS + "," + CROSS_CTE + ",\nfb AS (SELECT crossed.*, "
    + ", ".join(f"{b.category_copy(c)} AS {c}_cat" for c in ("employmentTitle", "title", "issueDate", "earliesCreditLine"))
    + " FROM crossed)"
)


def with_fb(ctes: str, select: str) -> str:
    body = "WITH " + FB_CTE + ("," + ctes if ctes else "") + "\n" + select
    return with_parsed(body)


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


def freq_ctes(cols, src="fb"):
    out = []
    for c in cols:
        out.append(
            f"fq_{c} AS (SELECT coalesce(CAST({c} AS VARCHAR), 'nan') AS k, "
            f"count(*) / (SELECT count(*) FROM {src})::DOUBLE AS freq FROM {src} GROUP BY 1)"
        )
    return ",\n".join(out)


def freq_join(c, alias, src_alias="x"):
    return f"LEFT JOIN fq_{c} {alias} ON coalesce(CAST({src_alias}.{c} AS VARCHAR), 'nan') = {alias}.k"


register(
    "freq_encode",
    with_fb(
        freq_ctes(FREQ_COLS),
        "SELECT x.id, "
        + ", ".join(f"{r(f'f{i}.freq')} AS {o}" for i, o in enumerate(FREQ_COLS.values()))
        + " FROM fb x "
        + " ".join(freq_join(c, f"f{i}") for i, c in enumerate(FREQ_COLS)),
    ),
)


def train_count_ctes(cols, src="fb"):
    return ",\n".join(
        f"tc_{c} AS (SELECT {c} AS k, CAST(count(*) AS DOUBLE) AS n FROM {src} WHERE is_train = 1 GROUP BY 1)"
        for c in cols
    )


register(
    "train_count_encode",
    with_fb(
        train_count_ctes(CROSSES),
        "SELECT x.id, "
        + ", ".join(f"coalesce(t{i}.n, 0.0) AS {c}_freq" for i, c in enumerate(CROSSES))
        + " FROM fb x "
        + " ".join(f"LEFT JOIN tc_{c} t{i} ON x.{c} IS NOT DISTINCT FROM t{i}.k" for i, c in enumerate(CROSSES)),
    ),
)


def kfold_ctes(cols, src="fb", k=5):
    parts = [f"kf_prior AS (SELECT avg(isDefault) AS prior FROM {src} WHERE is_train = 1)"]
    for c in cols:
        parts.append(
            f"kf_{c}_by AS (SELECT {c} AS k, {b.hash_fold('id', k)} AS f, CAST(sum(isDefault) AS DOUBLE) AS s_f, "
            f"count(*) AS n_f FROM {src} WHERE is_train = 1 AND {c} IS NOT NULL GROUP BY 1, 2)"
        )
        parts.append(
            f"kf_{c} AS (SELECT k, f, sum(s_f) OVER (PARTITION BY k) - s_f AS s, "
            f"sum(n_f) OVER (PARTITION BY k) - n_f AS n FROM kf_{c}_by "
            f"UNION ALL SELECT k, -1 AS f, sum(s_f) AS s, sum(n_f) AS n FROM kf_{c}_by GROUP BY k)"
        )
    return ",\n".join(parts)


def kfold_join(c, alias, k=5, src_alias="x"):
    fold = f"CASE WHEN {src_alias}.is_train = 1 THEN {b.hash_fold(f'{src_alias}.id', k)} ELSE -1 END"
    return f"LEFT JOIN kf_{c} {alias} ON {src_alias}.{c} = {alias}.k AND {fold} = {alias}.f"


def kfold_value(c, alias, m=50.0, src_alias="x"):
    p = "(SELECT prior FROM kf_prior)"
    return (
        f"CASE WHEN {src_alias}.{c} IS NULL THEN {p} ELSE "
        f"(coalesce({alias}.s, 0.0) + {p} * {m!r}) / (coalesce({alias}.n, 0) + {m!r}) END"
    )


register(
    "kfold_target_encode",
    with_fb(
        kfold_ctes(KFOLD_TE_COLS),
        "SELECT x.id, "
        + ", ".join(f"{r(kfold_value(c, f't{i}'))} AS te_{c}" for i, c in enumerate(KFOLD_TE_COLS))
        + " FROM fb x "
        + " ".join(kfold_join(c, f"t{i}") for i, c in enumerate(KFOLD_TE_COLS)),
    ),
)


def block_ctes(src, n_blocks=5, min_gap=1):
    w = "OVER (ORDER BY month)"
    nt = (
        f"CASE WHEN (SELECT count(*) FROM tb_months) >= {n_blocks} THEN ntile({n_blocks}) {w} "
        + " ".join(
            f"WHEN (SELECT count(*) FROM tb_months) = {j} THEN ntile({j}) {w}" for j in range(n_blocks - 1, 2, -1)
        )
        + f" ELSE ntile(2) {w} END"
    )
    return f"""
tb_months AS (SELECT DISTINCT time_key AS month FROM {src} WHERE is_train = 1 AND time_key > 0),
tb_rn AS (SELECT month, CAST({nt} AS INTEGER) AS block, row_number() {w} AS rn FROM tb_months),
tb AS (SELECT month, block, (min(rn) OVER (PARTITION BY block) - 1) >= {min_gap} AS valid FROM tb_rn)"""


register(
    "time_blocks",
    "WITH " + ENC_BASE + "," + block_ctes("enc_base") + "\nSELECT month, block, valid FROM tb",
)


def block_te_ctes(cols, src="fb"):
    parts = [f"bt_prior AS (SELECT avg(isDefault) AS prior FROM {src} WHERE is_train = 1)"]
    for c in cols:
        parts.append(f"""
bt_{c}_m AS (SELECT {c} AS k, time_key AS month, CAST(sum(isDefault) AS DOUBLE) AS s_m, count(*) AS n_m
             FROM {src} WHERE is_train = 1 AND {c} IS NOT NULL GROUP BY 1, 2),
bt_{c}_b AS (SELECT k, block, sum(s_m) AS s_b, sum(n_m) AS n_b FROM bt_{c}_m JOIN tb USING (month) GROUP BY 1, 2),
bt_{c} AS (
  SELECT k, block, sum(s_b) OVER w AS s, sum(n_b) OVER w AS n FROM bt_{c}_b
  WINDOW w AS (PARTITION BY k ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT k, -1 AS block, sum(s_m) AS s, sum(n_m) AS n FROM bt_{c}_m GROUP BY k
)""")
    return ",".join(parts)


def block_te_value(alias, src_alias="x"):
    p = "(SELECT prior FROM bt_prior)"
    mean = f"coalesce({alias}.s / {alias}.n, {p})"
    return (
        f"CASE WHEN {src_alias}.is_train = 1 THEN "
        f"(CASE WHEN (SELECT coalesce(bool_or(valid), false) FROM tb) THEN (CASE WHEN xb.valid THEN {mean} END) "
        f"ELSE {p} END) ELSE {mean} END"
    )


def block_te_join(c, alias, src_alias="x"):
    blk = f"CASE WHEN {src_alias}.is_train = 1 THEN xb.block ELSE -1 END"
    return f"LEFT JOIN bt_{c} {alias} ON {src_alias}.{c} = {alias}.k AND {blk} = {alias}.block"


register(
    "time_block_target_encode",
    with_fb(
        block_ctes("fb") + "," + block_te_ctes(BLOCK_TE_COLS),
        "SELECT x.id, x.time_key, "
        + ", ".join(f"{r(block_te_value(f't{i}'))} AS te_{c}" for i, c in enumerate(BLOCK_TE_COLS))
        + " FROM fb x LEFT JOIN tb xb ON x.time_key = xb.month "
        + " ".join(block_te_join(c, f"t{i}") for i, c in enumerate(BLOCK_TE_COLS)),
    ),
)

PAST_RATE_TEST = (
    "WITH " + ENC_BASE + "," + ",".join(past_rate_ctes(k) for k in PAST_RATE_KEYS) + "\n"
    + " UNION ALL ".join(
        f"SELECT '{k}' AS key_col, CAST(k AS VARCHAR) AS key, {r(f'coalesce(rate, (SELECT gr FROM pr_{k}_gr))')} AS rate "
        f"FROM pr_{k} WHERE m = -1"
        for k in PAST_RATE_KEYS
    )
)
for _key in ("past_rate_test", "past_rate_stream"):
    register(_key, PAST_RATE_TEST)


def woe_ctes(cols, style, src="fb", q=10):
    parts = []
    for c in cols:
        qq = q if style == "good_bad" else f"least({q}, (SELECT count(*) FROM {src} WHERE is_train = 1))"
        if style == "good_bad":
            edges = qbin_edges(c, q, src, "is_train = 1")
        else:  # q may shrink to the train row count; at sf >= 0.001 it stays q
            edges = qbin_edges(c, q, src, "is_train = 1")
        _ = qq
        parts.append(f"""
wo_{c}_e AS (SELECT {edges} AS e),
wo_{c}_b AS (
  SELECT {bin_index(c, 'e')} AS b, CAST(sum(isDefault) AS DOUBLE) AS bad, count(*) AS n
  FROM {src}, wo_{c}_e WHERE is_train = 1 GROUP BY 1 HAVING b IS NOT NULL
),
wo_{c}_t AS (SELECT sum(bad) AS bt, sum(n - bad) AS gt FROM wo_{c}_b)""")
    return ",".join(parts)


def woe_value(c, style, src_alias="x"):
    e = f"(SELECT e FROM wo_{c}_e)"
    bidx = bin_index(f"{src_alias}.{c}", e)
    bad = f"(SELECT bad FROM wo_{c}_b WHERE b = {bidx})"
    good = f"(SELECT n - bad FROM wo_{c}_b WHERE b = {bidx})"
    bt, gt = f"(SELECT bt FROM wo_{c}_t)", f"(SELECT gt FROM wo_{c}_t)"
    if style == "good_bad":
        w = f"ln((({good} + 0.5) / ({gt} + 0.5)) / (({bad} + 0.5) / ({bt} + 0.5)))"
        return f"CASE WHEN len({e}) < 3 THEN 0.0 ELSE coalesce({w}, 0.0) END"
    w = (f"ln(((coalesce({bad}, 0.0) + 0.5) / ({bt} + 1.0)) / "
         f"((coalesce({good}, 0.0) + 0.5) / ({gt} + 1.0)))")
    return f"CASE WHEN len({e}) < 2 OR {bidx} IS NULL THEN 0.0 ELSE coalesce({w}, 0.0) END"


for _name, _cols, _style in (("woe_good_bad", WOE_V2_COLS, "good_bad"), ("woe_bad_good", WOE_V3_COLS, "bad_good")):
    register(
        _name,
        with_fb(
            woe_ctes(_cols, _style),
            "SELECT x.id, " + ", ".join(f"{r(woe_value(c, _style))} AS woe_{c}" for c in _cols) + " FROM fb x",
        ),
    )

_card = " UNION ALL ".join(
    f"SELECT '{c}' AS cat_col, CAST(count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS nunique FROM fb"
    for c in CAT_COLS_V1
)
register("cardinality", with_fb("", _card))
register(
    "cardinality_downgrade",
    with_fb("card AS (" + _card + ")", "SELECT cat_col, nunique, nunique > 200 AS downgraded FROM card"),
)
register(
    "target_join",
    with_fb("", "SELECT fb.id, fb.time_key, fb.grade_term, l.isDefault FROM fb LEFT JOIN loans l ON fb.id = l.id"),
)
