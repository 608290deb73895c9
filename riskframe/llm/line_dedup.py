"""Line dedup: lines spread over many distinct sites are boilerplate.

Each line hash gets a HyperLogLog sketch of its sites; sketches merge by
aggregation, so a line held by a third of all rows is combined before it
shuffles. Lines whose estimate lies clearly over or under the threshold are
decided by the sketch. Those within the sketch's error band get an exact distinct
count of sites. Removed lines travel as positions per text; the text itself
moves once, in the join with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import clean_text, fresh, write_table

LG_K = 10
# Four standard errors of a sketch with 2^10 registers.
BAND = 4 * 1.04 / 2 ** (LG_K / 2)


def spread_lines(lines: DataFrame, min_sites: int, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """Line hashes found on at least ``min_sites`` sites: ``h1, h2, first``.

    ``lines``: h1, h2, site, id, th, pos. ``first`` is the smallest (id, text
    hash, position) that holds the line.
    """
    place = F.struct(F.col("id").isNull().alias("z"), "id", "th", "pos")
    sketched = write_table(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .where(F.col("n") >= min_sites)  # fewer rows can't be on so many sites
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("est")),
        "line-sketches",
    )
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    clear = sketched.where(F.col("est") > high).select("h1", "h2", "first")
    near = sketched.where(F.col("est").between(low, high)).select("h1", "h2", "first")
    exact = (
        lines.select("h1", "h2", "site")
        .join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return clear.union(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def drop_spread_lines(
    docs: DataFrame,
    min_sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    length_col: str | None = None,
    keep_first: bool = True,
    counts: bool = True,
) -> DataFrame:
    """The input with boilerplate lines removed from ``text``; with ``counts`` also ``n_lines`` and ``n_removed``.

    A line is what stands between line feeds, compared without leading and
    trailing spaces; blank lines always stay. With ``keep_first`` the smallest (id,
    text hash, position) that holds a boilerplate line keeps it, so no passage
    leaves the corpus altogether. ``length_col`` gets the new length of changed
    texts. A null text stays null (and has one blank line), a null site is no site, a
    null id sorts last. Repeated rows (same id and text) are treated alike. Each
    input row gives one row with all its columns (``counts`` overwrites two names);
    texts without such lines are unchanged; an empty table gives an empty result.
    """
    text = clean_text(text_col)
    pieces = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    line = F.trim("line")
    lines = write_table(
        pieces.where(line != "").select("id", "th", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")), "lines"
    )
    boiler = write_table(spread_lines(lines, min_sites), "boilerplate")
    hit = lines.join(boiler, ["h1", "h2"])
    if keep_first:
        hit = hit.where(~F.col("first").eqNullSafe(F.struct(F.col("id").isNull().alias("z"), "id", "th", "pos")))
    own_id, own_th, own_gone = fresh(docs, "__id", "__th", "__gone")
    gone = hit.groupBy(F.col("id").alias(own_id), F.col("th").alias(own_th)).agg(F.collect_set("pos").alias(own_gone))
    at = docs[id_col].eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col(own_th))
    joined = docs.join(gone, at, "left").drop(own_id, own_th)
    changed = F.col(own_gone).isNotNull()
    parts = F.split(text, "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(own_gone, i)), "\n")
    out = {}
    if counts:
        out |= {"n_lines": F.size(parts).cast("long"), "n_removed": F.when(changed, F.size(own_gone)).otherwise(0).cast("long")}
    if length_col:
        length = F.char_length(left).cast(docs.schema[length_col].dataType)
        out[length_col] = F.when(changed, length).otherwise(F.col(length_col))
    return joined.withColumns(out | {text_col: F.when(changed, left).otherwise(F.col(text_col))}).drop(own_gone)


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d),
b AS (
  SELECT trim(line) AS line, min(row(doc_id, pos)) AS first
  FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
k AS (
  SELECT l.doc_id, l.pos, l.line,
         b.line IS NOT NULL AND row(l.doc_id, l.pos) <> b.first AS gone
  FROM l LEFT JOIN b ON trim(l.line) = b.line)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines,
       count(*) FILTER (gone) AS n_removed
FROM k GROUP BY doc_id
"""
