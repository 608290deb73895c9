"""Exact dedup by content sort.

Rows are range-partitioned on the head of the normalised bytes by sampled
splitters (a hash of the whole text parts texts with a common head) and sorted
externally by the whole bytes, so equal texts are adjacent; a window over the
sorted rows compares neighbouring texts in full and names the row that stays. No
hash decides equality inside a partition. Splitters are sampled from heads and
hashes, so what the driver holds of them doesn't grow with the texts' length.

Hot texts: a text that more than a quarter of a partition's share of rows hold
is dealt over several sub-ranges ``(text, salt)``. Each sub-range is resolved
by the same sort, and the few winners per hot text are merged by the SHA-256 of
the text. There are at most ``4 x partitions`` hot texts, which bounds the
broadcast side of that merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import ASCII_SPACE, clean_text, shuffle_partitions, write_table

HEAD = 32


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, ASCII_SPACE, "")


def _hot_texts(keyed: DataFrame, partitions: int) -> DataFrame:
    """Hashes of texts held by more than 1/(4 * partitions) of all rows: ``h, salts``.

    At most ``4 * partitions`` rows, since the shares add up to one.
    """
    share = keyed.count() / (4 * partitions)
    counts = keyed.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where((F.col("n") > 1) & (F.col("n") > share))
    return write_table(hot.select("h", F.ceil(F.col("n") / F.lit(max(share, 1.0))).cast("int").alias("salts")), "hot-texts")


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space. Of equal
    texts the row with most code points in the original text stays, then the
    smallest id. Null text is empty text; a null id sorts after every other id.
    Repeated rows (same id and text) count one by one in ``group_size`` and only
    one of them has ``kept``. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    parts = partitions or shuffle_partitions(spark)
    text = clean_text(text_col)
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(text).alias("chars"),
        normalise(text).alias("norm"),
    )
    hot = _hot_texts(keyed, parts)
    salted = (
        keyed.withColumn("head", F.substring("norm", 1, HEAD))
        .withColumn("h", F.xxhash64("norm"))
        .join(F.broadcast(hot), "h", "left")  # at most 4 x partitions rows
        .withColumn(
            "salt",
            F.coalesce(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("salts")).cast("int"), F.lit(-1)),
        )
        .select("id", "chars", "head", "h", "norm", "salt")
    )
    dealt = salted.repartitionByRange(parts, "head", "h", "salt")
    order = Window.partitionBy("head", "h", "salt", "norm").orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = dealt.select(
        "id",
        "chars",
        "salt",
        F.row_number().over(order).alias("rn"),
        F.first("id").over(whole).alias("first_id"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    ranked = write_table(ranked, "content-sort")
    merged = (
        ranked.where((F.col("salt") >= 0) & (F.col("rn") == 1))
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("chars")).alias("c"), F.col("first_id").isNull().alias("z"), "first_id", "salt")).alias("win"),
            F.sum("n").alias("total"),
        )
    )
    win = F.col("win")
    return (
        ranked.join(F.broadcast(merged), "text_sha256", "left")  # at most 4 x partitions rows
        .select(
            F.col("id").alias(id_col),
            F.when(win.isNull(), F.col("first_id")).otherwise(win["first_id"]).alias("keep_id"),
            F.coalesce("total", "n").cast("long").alias("group_size"),
            ((F.col("rn") == 1) & (win.isNull() | (win["salt"] == F.col("salt")))).alias("kept"),
            "text_sha256",
        )
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
