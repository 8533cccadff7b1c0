"""Connected components of a graph that is too large for one machine: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges from which on each round's minima are written before they are joined: the join's sides aren't bound to tasks by their keys then, and Spark can split a hub's edges.
MANY_EDGES = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, component): for every node of an edge the smallest node that it is connected with.

    Each round moves every node's larger (then smaller) neighbours under the smallest one; the edges
    never grow in number and become stars in few rounds. Rounds are written to the shared folder.
    Nulls and loops are ignored; repeated edges count once; without edges there are no rows.
    """

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def written(df: DataFrame) -> DataFrame:
        return stored(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")

    def apart(least: DataFrame) -> DataFrame:
        if state[0] < MANY_EDGES:
            return least
        minima.append(stored(least, "minima"))
        return minima[-1]

    now = written(edges)
    state = summary(now)
    while state[0]:
        minima: list[DataFrame] = []
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = apart(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = apart(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # A node above several others goes under the smallest itself, too.
        small = written(small.unionByName(least.select("a", F.col("m").alias("b"))))
        after = summary(small)
        discard(now, large, *minima)
        now = small
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
