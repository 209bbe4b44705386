"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in `links` (u, v): root is the smallest node
    that can be reached.

    Each round links a node's larger neighbours to its smallest one, then its smaller ones,
    until every node points at its root (logarithmically many rounds). A node's links are
    never gathered in one row; each round is written to the shared folder.
    """
    links = stored(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(links.distinct(), "links")
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        links = links.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
                least.select("u", F.col("m").alias("v")))
        links = stored(links.distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
