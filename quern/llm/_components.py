"""Connected components of a link table by alternating large-star and small-star.

Every round is a handful of aggregations and equi-joins on node ids. Minima
are combined before they are shuffled, and hubs are left to the adaptive skew
join, so no task gathers a component and nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._store import forget, mark, stored


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``; component is the smallest node.

    Only nodes that have a link to another node are returned. Repeated links,
    links to oneself and either direction are fine; nulls are ignored.
    """
    edges = stored(_oriented(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    state = _digest(edges)
    while state[0]:
        since = mark() - 1
        # The table of the round before is still being read here, so it goes after this round's is written.
        edges = stored(_small_star(_large_star(edges)), "links")
        forget(edges.sparkSession, since, since + 1)
        now = _digest(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(joined.union(least.select("a", F.col("m").alias("b"))))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1], row[2]
