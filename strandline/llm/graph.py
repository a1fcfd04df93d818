"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_table, scratch_table


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node in ``links`` (columns a, b), component the least node reachable.

    Each round hooks every node's larger neighbours to its least neighbour, then its smaller ones
    (large star, small star); the number of rounds grows with the logarithm of the longest chain. A round's links are
    written to the shared folder, so lineage stays short. A node's neighbours are aggregated before they are shuffled and never
    gathered in a list; loops and repeated links change nothing; no links give no rows.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    current = scratch_table(links.selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "links")
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    previous = mark(current)
    for _ in range(most_rounds):
        both = current.unionByName(current.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("case when b = m then a else b end as a", "m as b").distinct()
        after = scratch_table(small, "links")
        now = mark(after)
        drop_table(current)
        current, settled, previous = after, now == previous, now
        if settled:
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds: {previous}")
    return current.selectExpr("a as node", "b as component").unionByName(current.selectExpr("b as node", "b as component").distinct())
