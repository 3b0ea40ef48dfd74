"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with u > v. Each step links nodes to the least of a neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link to another.

    Each round is written to the shared folder and its predecessor deleted; hubs are met
    by partial minima before the shuffle. The rounds needed grow with the logarithm of a
    component's size. Links with a NULL end are none; an empty table gives an empty result.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "edges")
    sign = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    before = sign(edges)
    for _ in range(rounds):
        if not before["n"]:
            break
        last, edges = edges, materialize(_stars(_stars(edges, True), False), "edges")
        discard(last)
        after = sign(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
