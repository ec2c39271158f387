"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut


def components(links: DataFrame, kind: str) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the smallest node of its component.

    A large star links each node's larger neighbours to its smallest neighbour, a small star links
    its smaller neighbours and itself to it; both keep the components, and repeated they leave one
    star per component after O(log^2 n) rounds. Minima are taken before the shuffle and joined back
    by shuffle, so a node with many links stays in no single task. Every round is written to the
    shared folder. Links from a node to itself and repeated links do no harm.
    """
    a, b = (F.col(c).cast(kind) for c in ("a", "b"))
    edges = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct(), "links")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least.hint("merge"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = cut(small.filter("a <> b").distinct(), "links")
        # The same links as in the round before: one star per component.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
