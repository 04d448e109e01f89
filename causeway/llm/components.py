"""Connected components of a distributed link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import stored

MAX_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    """(k, m): the least neighbour of each node u, pre-aggregated before the shuffle.

    k is ~u: a join on it deals both sides anew, so that the links of a hub can be split between tasks.
    """
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to its least neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.withColumn("k", F.bitwise_not("u")).join(_least(both), "k").where("v > u")
    return out.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours link to the least of them. Links run from the larger u to the smaller v."""
    least = _least(links)
    out = links.withColumn("k", F.bitwise_not("u")).join(least, "k").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select(F.bitwise_not("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node with a link, the least node reachable, from links (u, v) of long ids.

    Links to itself and repeated links do no harm; no links, no rows. Each round ends in a table in the shared
    folder; rounds grow as the logarithm of the longest chain.
    """
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        now = stored(_small_star(_large_star(now)), "links")
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
