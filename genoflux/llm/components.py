"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations and two joins; a node with very many links is summed map-side and its rows in the joins are
split by adaptive execution. Nothing is collected but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _lowest(links: DataFrame) -> DataFrame:
    """(u, m): the least of each node u and its neighbours v."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _check(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (u, v), any order, repeats allowed -> (node, root): root is the least node reachable; only nodes that are not
    their own root are listed. Self links and nulls count for nothing. An empty table gives an empty table."""
    both = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    now = scratch.write(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _check(now)
    while seen[0]:
        sym = now.select(F.explode(both).alias("e")).select("e.u", "e.v")
        large = sym.join(_lowest(sym), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.write(large)
        low = _lowest(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = scratch.write(small)
        scratch.drop(now, large)
        now, before = after, seen
        seen = _check(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
