"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins, written to the shared folder;
rounds grow with the logarithm of the longest path.  No node's neighbours are
ever gathered, so a hub costs no more than its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneweave.llm.common import discard, made, staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root of every node with an edge, the root itself left out; roots are the smallest ids.

    Edges with a null end and loops are ignored.
    """
    spot = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b and a is not null and b is not null").distinct(), "edges")
    mark = tuple(now.agg(F.count(F.lit(1)), spot).first())
    while mark[0]:
        before = made[-1]
        now = staged(_small(_large(now)), "edges")
        discard(now.sparkSession, [before])
        new = tuple(now.agg(F.count(F.lit(1)), spot).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
