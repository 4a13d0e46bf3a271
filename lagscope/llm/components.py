"""Connected components of a graph given as an edge table.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every round is two aggregations
and joins, the number of rounds grows with the logarithm of the graph, and no
vertex's neighbours are ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link a vertex's neighbours to the smallest vertex it sees.

    ``edges`` holds each link once as (u > v).  The large step looks from every
    vertex at all its neighbours and re-links the larger ones, the small step
    only at the smaller ones and itself.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")),
                      "cc-least")
        seen = attach(both, least, "u", "n", ["m"]).where("v > u").selectExpr("v AS u", "m AS v")
    else:
        least = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        seen = attach(edges, least, "u", "n", ["m"]).selectExpr("v AS u", "m AS v")
        seen = seen.union(least.selectExpr("u", "m AS v"))
    return stage(seen.where("u > v").distinct(), "cc-edges")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (columns a, b; any order, repeats
    and self-links allowed) that is not itself the smallest of its component.

    Runs until a round changes nothing; there is no cap on rounds.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stage(links, "cc-edges")
    before = None
    while True:
        links = _star(_star(links, large=True), large=False)
        # the stars are finished when every vertex hangs on one root that
        # hangs on nothing; the checks compare order-free sums of the edges
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select("u", F.col("v").alias("root"))
        before = now
