"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; in the input a > b."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionAll(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` long links in, ``(node, root)`` out: one row per linked node, root the smallest node reachable.

    Links may repeat, run both ways or join a node with itself; a null end is no link. Nodes without a link to
    another node are not in the result. Each round is two joins and two aggregates on narrow rows, written to the
    shared folder, so a lost executor costs one round at most; the number of rounds grows with the logarithm of
    the longest chain. A node with very many links is one hot join key, which adaptive execution splits."""
    state = materialise(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = None
    while True:
        now = mark(state)
        if now == seen or now[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        state = materialise(_small_star(_large_star(state)))
