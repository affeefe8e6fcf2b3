"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import keep


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the smallest node that it is linked with.

    Alternating large-star and small-star rounds, each a few aggregations and joins over
    links, until every node hangs on one node that hangs on none. Each round is written to
    the shared folder. Links of a node with itself are dropped, repeats are harmless.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = keep(links, "links")
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        lower = links.join(least, "b").select("a", F.col("m").alias("b"))  # a node's larger neighbours, on its least one
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        lifted = lower.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = keep(lifted.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        ends = links.select(F.col("a").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(links.select(F.col("b").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
