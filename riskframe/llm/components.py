"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import write_table


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of the undirected edges ``a, b`` (a <> b), root its component's smallest vertex.

    A large star ties a vertex's larger neighbours to its smallest one, a small
    star its smaller ones. Both are a minimum per vertex, combined before it
    shuffles, and a join on the vertex; a vertex with a third of all edges only
    makes that join's splittable side large. The edges become stars on the roots
    after a number of rounds logarithmic in the vertices; the loop ends when a round
    changes nothing. Each round is written, so a lost executor costs one round.
    """
    now = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large.where("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), large.u == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_table(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v").alias("root")).distinct())
