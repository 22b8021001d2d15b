"""Connected components of a link table by alternating large-star and small-star steps, all as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

MOST_ROUNDS = 60
#: Up to this many edges, the smallest neighbours (a row for each node at most) are broadcast instead of shuffled, and a few
#: partitions hold them all: rounds would else leave files for every partition of the cluster.
FEW, PARTS = 500_000, 8


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (columns a, b; direction ignored).

    Each round moves every node's larger neighbours to its smallest one; partial aggregation keeps a node with very
    many neighbours from gathering them in one task. Stops when a round changes nothing. Null ends link nothing.
    """
    spark = links.sparkSession
    edges, state = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint(), None
    n = edges.count()
    few = n <= FEW
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = edges.coalesce(PARTS) if few else edges
    for k in range(MOST_ROUNDS):
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few, larger_only=True)
        small = _star(large, few, larger_only=False).checkpoint()
        before, edges = state, small
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        few = state[0] <= FEW
        if k % 2:
            release(spark)  # else the small shuffle files of many rounds lie about until the driver collects its garbage
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star(edges: DataFrame, few: bool, larger_only: bool) -> DataFrame:
    """For each u with neighbours v: link (v > u only, or u itself and v < u) to the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.coalesce(PARTS) if few else least
    both = edges.join(F.broadcast(least) if few else least, "u").withColumn("m", F.least("u", "m"))
    if larger_only:
        out = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(both.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v").distinct()
    return out.coalesce(PARTS) if few else out
