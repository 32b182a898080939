"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links (a, b)``, both long: ``root`` is one node of its component.

    Each round hooks every node to its smallest neighbour, halves the paths until all nodes point at roots, and
    goes on with the links between different roots; both kinds of round are few, as each at least halves what is
    left. Minima are taken before the shuffle, and joins on a root that many nodes share can be split.
    """
    total, left = None, written(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        up = written(up.select("node", F.least("node", "b").alias("root"), F.lit(True).alias("moved")), "roots")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = up.drop("moved").join(above, "root").select("node", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved"))
            step = written(step, "roots")
            discard(up)
            up = step
            if not up.filter("moved").limit(1).count():
                break
        if total is None:
            new = written(up.drop("moved"), "roots")
        else:
            more = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = written(total.join(more, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            discard(total)
        total = new
        ends = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rest = left.join(ends, "a").join(ends.toDF("b", "rb"), "b").filter(F.col("ra") != F.col("rb"))
        rest = written(rest.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        discard(left, up)
        left = rest
        if not left.limit(1).count():
            discard(left)
            return total
