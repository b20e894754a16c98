"""Connected components of an edge table, with alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.store import saved


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Connect the neighbours of each node to the least of them. `pairs` (a, b) has both directions or, small, a > b."""
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    met = pairs.join(least, "a")
    out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of `edges` that has a partner; root is the least node that it reaches.

    Each round writes its edges to the shared folder. The rounds grow with the logarithm of the longest path, not with
    the data; the driver sees two sums a round. Self loops and nulls are left out; repeated edges do no harm.
    """
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a > b").distinct()
    now, before = saved(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = saved(_star(_star(both, False), True), "edges")
        print_ = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = print_
