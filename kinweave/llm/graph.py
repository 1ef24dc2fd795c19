"""Connected components by alternating stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common


def stars(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge between two different nodes, without the roots' own rows: edges that give the same components.

    A large star hangs the larger neighbours of each node on its smallest neighbour, a small star
    the smaller ones; the edges end as stars round the roots after some log(diameter) rounds. Minima
    combine on the map side, the joins back can be split by adaptive execution where a node has
    many edges, and each round is a written table, so no lineage grows and a lost executor costs
    one round at most.

    Whether the edges are stars already is counted while the large star is written: no node has both
    larger and smaller neighbours, and none has two smaller ones. So no round is run to see that
    nothing changes, and no table is read again only to be compared."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = common.saved(edges.filter(F.col(a) != F.col(b)).select(u, v).distinct())
    ended = now.isEmpty()
    while not ended:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        seen = Observation()
        hung = both.join(least, "n").observe(seen, F.count_if(F.expr("(x > n and m < n) or (x < n and m < x)")).alias("off"))
        # A row for each edge: equal ones need not go before the smaller neighbours are hung.
        large = common.saved(hung.filter("x > n").select(F.col("x").alias("u"), F.col("m").alias("v")))
        ended = not seen.get["off"]
        if not ended:
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            after = common.saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
            common.discard(now)
            now = after
        common.discard(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(hung: DataFrame) -> DataFrame:
    """stars() with the roots' own rows."""
    own = hung.select(F.col("root").alias("node"), "root").distinct()
    return hung.unionByName(own)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge between two different nodes."""
    return rooted(stars(edges, a, b))
