"""Filter interaction audit by a Gray-code walk over the subsets of filters.

Each row fails some of k filters; the set of those is its mask. Spark counts
rows per part and mask (at most 2^k cells a part, combined before the shuffle).
The walk then goes through all subsets of active filters, toggling one filter
at a time: every cell keeps the number of active filters that it fails, and a
cell enters or leaves the running survivors when that number leaves or reaches
zero. The survivors of each of the 2^k subsets are stored; whatever a step of
any order does is the difference of two stored states. No order is replayed
over rows, and a part's work doesn't grow with its rows.

The filters of ``document_masks`` (words: maximal runs outside ASCII white space):
A under 200 words, B under half of the words distinct, C more than 3 % of the
code points in A-Z, D holds one of ``#$%&*|``, E the text of a smaller id.

Nulls and odd input: null text is empty text (it fails A alone, and E after the
smallest id with an empty text); a null part is the part ''; a null id is neither
smaller nor greater than any other, so it neither fails E nor makes others fail;
repeated rows count one by one, and rows with the smallest id of a text never
fail E. Labels are joined by id; several labels of an id count if any is 1; a
document without labels is neither good nor toxic. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ASCII_SPACE, clean_text, write_table

FILTERS = "ABCDE"
SPACES = " \t\n\x0b\f\r"
MAX_FILTERS = 8
COUNTS = ("n", "good", "toxic")


def row_masks(text: Column) -> Column:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    inner = F.btrim(text, F.lit(SPACES))
    bit = lambda test, i: F.when(test, 1 << i).otherwise(0)
    # The lambda's variable makes sure that the words are cut once.
    of_words = F.transform(
        F.array(F.split(inner, ASCII_SPACE)),
        lambda w: bit(F.size(w) < 200, 0) + bit(100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long"), 1),
    )
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    by_words = F.when(inner == "", 1).otherwise(F.element_at(of_words, 1))  # no words: under 200, and no half of them
    return by_words + bit(100 * capitals > 3 * F.length(text).cast("long"), 2) + bit(text.rlike("[#$%&*|]"), 3)


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Cells ``part, mask, n, good, toxic`` of documents under the filters A to E.

    Texts travel as their SHA-256. Copies of a text meet only after they have
    been counted per (text, part, labels), each group with its smallest id and
    the number of rows that have it, so a text that a third of all rows hold is a few rows.
    """
    text = clean_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        row_masks(text).alias("bits"),
    )
    # A repeated id may hold many rows: counted before the join with its labels.
    rows = rows.groupBy("id", "digest", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    least = F.min("id")
    groups = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"),
        least.alias("least"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))["n"].alias("n_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    groups = write_table(groups, "audit-groups")  # read twice; the texts are read once
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    groups = groups.join(first, "digest")  # one row per text, part and labels on the left
    safe = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.explode(
        F.array(
            F.struct(F.col("bits").alias("mask"), safe.alias("k")),
            F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - safe).alias("k")),
        )
    )
    cells = groups.select("part", "good", "toxic", split.alias("c")).where("c.k > 0")
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.k").alias("n"), F.sum(F.col("c.k") * F.col("good")).alias("good"), F.sum(F.col("c.k") * F.col("toxic")).alias("toxic")
    )


def gray_walk(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors' counts under every subset of active filters: an array (2^k, counts a cell).

    ``masks``: the failures of each cell; ``counts``: its counts, one row a cell.
    """
    failing = np.zeros(len(masks), np.int64)  # active filters that each cell fails
    alive = counts.sum(axis=0)
    states = np.empty((1 << k, counts.shape[1]), np.int64)
    states[0] = alive
    active = 0
    for step in range(1, 1 << k):
        bit = step & -step  # the bit in which the Gray codes of step - 1 and step differ
        hit = (masks & bit) != 0
        active ^= bit
        if active & bit:
            alive = alive - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + counts[hit & (failing == 0)].sum(axis=0)
        states[active] = alive
    return states


def order_steps(filters: str) -> list[tuple[str, int, int, int]]:
    """Every step of every order: the order, the step from 1, its filter's place, the filters active before as bits."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(filters[i] for i in order), step, f, before))
            before |= 1 << f
    return out


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does at each step of each order, per part.

    ``cells``: ``part, mask, n, good, toxic``, a row per part and mask (bit i of
    the mask: the row fails the i-th filter). Returned per part, order and step:
    ``kept`` after it, ``removed`` by it, ``redundant`` (fail its filter, gone
    before), ``unique_fails`` (fail its filter only), ``good_lost``,
    ``toxic_lost``, and ``shapley``: its filter's ``removed`` summed over all orders.
    """
    k = len(filters)
    if k > MAX_FILTERS or len(set(filters)) != k:
        raise ValueError(f"one letter a filter, at most {MAX_FILTERS} (orders grow with the factorial)")
    steps = order_steps(filters)
    names = pa.array([s[0] for s in steps])
    place = pa.array([s[1] for s in steps], pa.int32())
    f = np.array([s[2] for s in steps])
    before = np.array([s[3] for s in steps])
    after = before | (1 << f)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in SCHEMA.replace(",", "").split()[6::2]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                masks = np.array([r["mask"] for r in rows], np.int64)
                states = gray_walk(masks, np.array([[r[c] for c in COUNTS] for r in rows], np.int64), k)
                lost = states[before] - states[after]
                n = states[:, 0]
                fails = np.array([n[0] - n[1 << i] for i in range(k)])
                alone = np.array([n[((1 << k) - 1) ^ (1 << i)] - n[-1] for i in range(k)])
                shapley = np.array([lost[f == i, 0].sum() for i in range(k)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps), pa.string()), names, place]
                    + [pa.array(c, pa.int64()) for c in (n[after], lost[:, 0], fails[f] - lost[:, 0], alone[f], lost[:, 1], lost[:, 2], shapley[f])],
                    schema=schema,
                )

    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 2^k structs a part
    return per_part.mapInArrow(walk, SCHEMA)


def audit_documents(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """The audit of the filters A to E over documents, per value of ``part_col``."""
    return audit_orders(document_masks(docs, labels, part_col=part_col))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(words) < 200)::INT AS a,
         (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM d LEFT JOIN marks l ON l.doc_id = d.doc_id),
cells AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letters(i, f) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
orders AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order
  FROM letters p JOIN letters q ON q.i <> p.i JOIN letters r ON r.i NOT IN (p.i, q.i)
  JOIN letters s ON s.i NOT IN (p.i, q.i, r.i) JOIN letters u ON u.i NOT IN (p.i, q.i, r.i, s.i)),
steps AS (
  SELECT filter_order, step, l.i AS own,
         list_transform(string_split(left(filter_order, step - 1), ''), lambda x: ascii(x) - 64) AS earlier
  FROM orders, range(1, 6) g(step) JOIN letters l ON l.f = substr(filter_order, step, 1)),
told AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] = 1 AS mine,
         step > 1 AND len(list_filter(earlier, lambda x: x > 0 AND fails[greatest(x, 1)] = 1)) > 0 AS gone, list_sum(fails) AS k
  FROM cells, steps),
t AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT gone AND NOT mine THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mine AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mine AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mine AND k = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mine AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mine AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM t
"""
