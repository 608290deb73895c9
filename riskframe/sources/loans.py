"""The ``loans`` view: one loan per order that has line items.

The raw loan table of the modelled problem (47 columns, one row per loan) is
bound to the driver tables as documented in FIXTURES.md §3. Only max/min/count
aggregates feed it, so values do not depend on summation order and match any
other engine bit for bit.

Plan shape: ``lineitem`` is aggregated by order key (partial + final hash
aggregate, one shuffle on ``l_orderkey``); ``orders`` is aggregated by customer
(one shuffle on ``o_custkey``); the joins are equi-joins that AQE turns into
broadcast joins only where the runtime size of a side is small (``customer``,
``part`` at small scale) and keeps as sort-merge joins otherwise. A hot order or
customer key is handled by AQE skew-join splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskframe.session import configure
from riskframe.sources.tables import read_table

ID = "id"
TARGET = "isDefault"
SPLIT = "is_train"

# Raw loan columns produced by the view, in order.
LOAN_COLUMNS = [
    "id", "is_train", "isDefault", "loanAmnt", "term", "interestRate", "installment",
    "grade", "subGrade", "employmentTitle", "employmentLength", "homeOwnership",
    "annualIncome", "issueDate", "purpose", "postCode", "regionCode", "dti",
    "ficoRangeLow", "ficoRangeHigh", "openAcc", "revolBal", "revolUtil", "totalAcc",
    "earliesCreditLine", "title", "policyCode",
    "n0", "n1", "n2", "n3", "n4", "n5",
]


# The raw table's 47 columns and their types, in file order, and
# the integer codes that are categories.
RAW_SCHEMA = (
    "id long, loanAmnt double, term int, interestRate double, installment double, grade string, subGrade string, "
    "employmentTitle double, employmentLength string, homeOwnership int, annualIncome double, verificationStatus int, "
    "issueDate string, isDefault int, purpose int, postCode double, regionCode int, dti double, delinquency_2years double, "
    "ficoRangeLow double, ficoRangeHigh double, openAcc double, pubRec double, pubRecBankruptcies double, revolBal double, "
    "revolUtil double, totalAcc double, initialListStatus int, applicationType int, earliesCreditLine string, title double, "
    "policyCode double, " + ", ".join(f"n{i} double" for i in range(15))
)
CODE_COLUMNS = ["grade", "subGrade", "homeOwnership", "verificationStatus", "purpose", "regionCode",
                "initialListStatus", "applicationType", "policyCode"]


def raw_schema() -> StructType:
    """S1 the raw loan table (train: 47 columns; test files lack the target)."""
    return StructType.fromDDL(RAW_SCHEMA)


def read_raw(spark: SparkSession, path: str, categories: bool = True) -> DataFrame:
    """S1 one raw file or folder, CSV with a header or Parquet, in the raw schema.

    CSV columns are matched by header name and read as text, then cast, so order
    and absent columns (the target in test files) don't matter and an unparsable
    number becomes null. ``categories`` casts the codes to text (P14).
    """
    schema = {f.name: f.dataType for f in raw_schema().fields}
    csv = path.rstrip("/").lower().endswith((".csv", ".csv.gz"))
    df = spark.read.csv(path, header=True) if csv else spark.read.parquet(path)
    known = [c for c in schema if c in df.columns]

    def typed(c: str) -> Column:
        kind = schema[c].simpleString()
        x = F.col(c)
        if csv and kind in ("int", "bigint"):
            x = x.try_cast("double")  # codes may be written as 3.0
        return x.try_cast(kind).alias(c)

    out = df.select(*[typed(c) for c in known])
    return codes_as_text(out) if categories else out


def codes_as_text(df: DataFrame) -> DataFrame:
    """P14 the integer codes that name a category, as text (a whole double loses its ".0")."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        whole = F.col(c).try_cast("bigint").cast("string") if kind in ("double", "float") else F.col(c).cast("string")
        return whole

    return df.withColumns({c: text(c) for c in CODE_COLUMNS if c in df.columns})


def require_unique(df: DataFrame, key: str = ID) -> DataFrame:
    """D19 the same rows; raises if a key is null or held by two rows."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).limit(5).collect()
    if bad:
        raise ValueError(f"{key} is not unique: {[r[key] for r in bad]}")
    return df


def read_train_test(spark: SparkSession, train_path: str, test_path: str) -> DataFrame:
    """S1, U1 both raw files as one table with ``is_train``; ids are unique in each (D19)."""
    train, test = (require_unique(read_raw(spark, p)) for p in (train_path, test_path))
    return union_train_test(train, test.drop(TARGET))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _line_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("li_n"),
        F.max("l_extendedprice").alias("li_max_price"),
        F.min("l_extendedprice").alias("li_min_price"),
        F.max("l_linenumber").alias("li_max_line"),
        F.max("l_discount").alias("li_max_disc"),
        F.max("l_tax").alias("li_max_tax"),
        F.min("l_partkey").alias("li_min_part"),
        F.min("l_suppkey").alias("li_min_supp"),
        _count_if(F.col("l_returnflag") == "R").alias("li_n_r"),
        _count_if(F.col("l_returnflag") == "A").alias("li_n_a"),
        _count_if(F.col("l_linestatus") == "O").alias("li_n_o"),
        F.max("l_quantity").alias("li_max_qty"),
        F.min("l_quantity").alias("li_min_qty"),
    )


def _customers(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_custkey").alias("cu_custkey")).agg(
        F.count(F.lit(1)).alias("cu_n_orders"),
        F.min("o_orderdate").alias("cu_first_date"),
    )


def load_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the loan table from ``orders``, ``lineitem``, ``customer``, ``part``."""
    configure(spark)
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    part = read_table(spark, sf_dir, "part")

    li = _line_items(lineitem)
    cu = _customers(orders)
    return _loans(
        orders.join(li, orders.o_orderkey == li.l_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(cu, orders.o_custkey == cu.cu_custkey)
        .join(part, part.p_partkey == li.li_min_part)
    )


def staged_loans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``load_loans`` for readers of all columns, by way of written tables, which come along.

    The line items of an order, the same with their part, and orders with their customer are
    written one after the other, so that each one's shuffles go before the next and
    the rows are dealt out once in the end, by order. The joins are the same inner
    joins in another order.
    """
    from riskframe.plans.common import forget, write_lean

    configure(spark)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    li = write_lean(_line_items(read_table(spark, sf_dir, "lineitem")), "lines")
    items = write_lean(li.join(part, part.p_partkey == li.li_min_part), "items")
    forget(li)
    cu = _customers(orders)
    owned = write_lean(orders.join(customer, orders.o_custkey == customer.c_custkey).join(cu, orders.o_custkey == cu.cu_custkey), "owned")
    return _loans(owned.join(items, owned.o_orderkey == items.l_orderkey)), [owned, items]


def _loans(j: DataFrame) -> DataFrame:
    """The raw loan columns of orders joined with their line items, customer, the customer's orders and part."""
    k12 = F.col("c_custkey") % 12
    grade = F.substring("o_orderpriority", 1, 1)
    fico_step = (F.col("p_size") % 25) * 10
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1).alias("is_train"),
        F.when(2 * F.col("li_n_r") >= F.col("li_n"), 1).otherwise(0).alias("isDefault"),
        F.col("li_max_price").alias("loanAmnt"),
        F.col("li_max_line").alias("term"),
        (F.col("li_max_disc") * 100).alias("interestRate"),
        F.col("li_min_price").alias("installment"),
        grade.alias("grade"),
        F.concat(grade, F.col("li_max_line").cast("string")).alias("subGrade"),
        F.col("li_min_part").cast("double").alias("employmentTitle"),
        F.when(k12 == 0, F.lit(None).cast("string"))
        .when(k12 == 1, F.lit("< 1 year"))
        .when(k12 == 11, F.lit("10+ years"))
        .otherwise(F.concat((k12 - 1).cast("string"), F.lit(" years")))
        .alias("employmentLength"),
        F.col("o_orderstatus").alias("homeOwnership"),
        F.col("c_acctbal").alias("annualIncome"),
        F.date_format("o_orderdate", "yyyy-MM").alias("issueDate"),
        F.col("c_mktsegment").alias("purpose"),
        F.col("li_min_supp").cast("double").alias("postCode"),
        F.col("c_nationkey").alias("regionCode"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("li_max_tax") * 100)
        .alias("dti"),
        (F.lit(600) + fico_step).cast("double").alias("ficoRangeLow"),
        (F.lit(604) + fico_step).cast("double").alias("ficoRangeHigh"),
        F.col("li_n").cast("double").alias("openAcc"),
        F.col("p_retailprice").alias("revolBal"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit(None).cast("double"))
        .otherwise(2 * F.col("li_max_qty"))
        .alias("revolUtil"),
        F.col("cu_n_orders").cast("double").alias("totalAcc"),
        F.date_format("cu_first_date", "MMM-yyyy").alias("earliesCreditLine"),
        F.col("p_size").cast("double").alias("title"),
        F.lit(1.0).alias("policyCode"),
        F.col("li_n").cast("double").alias("n0"),
        F.col("li_n_r").cast("double").alias("n1"),
        F.when(F.col("li_n_a") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("li_n_a").cast("double"))
        .alias("n2"),
        F.col("li_max_line").cast("double").alias("n3"),
        F.col("li_n_o").cast("double").alias("n4"),
        F.when(F.col("li_min_qty") > 40, F.lit(None).cast("double"))
        .otherwise(F.col("li_min_qty"))
        .alias("n5"),
    )


def supervised_view(loans: DataFrame, target: str = TARGET, split: str = SPLIT) -> DataFrame:
    """The view with the target nulled on test rows, as supervised operators expect."""
    return loans.withColumn(
        target, F.when(F.col(split) == 1, F.col(target)).otherwise(F.lit(None).cast("int"))
    )


def split_train_test(df: DataFrame, target: str = TARGET, split: str = SPLIT):
    """P1: train rows without the split flag; test rows without flag and target."""
    train = df.filter(F.col(split) == 1).drop(split)
    test = df.filter(F.col(split) == 0).drop(split, target)
    return train, test


def union_train_test(train: DataFrame, test: DataFrame, split: str = SPLIT) -> DataFrame:
    """U1: union by name; the test side lacks the target, which becomes null."""
    return train.withColumn(split, F.lit(1)).unionByName(
        test.withColumn(split, F.lit(0)), allowMissingColumns=True
    )
