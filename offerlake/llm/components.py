"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import durable


def _marks(edges: DataFrame) -> tuple:
    """A fingerprint of the set of edges (an order-free sum), to see when a round changes nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each id in links (u, v), the smallest id that it is connected with.

    Links may repeat and run either way; those with a null end or from an id to itself give nothing. Ids without links to
    others don't come out. Each round joins links with the smallest neighbour of each id, which is aggregated before it is
    shuffled; no neighbourhood is gathered in one row.
    """
    edges = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges, "components")
    before = _marks(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u is linked to the least around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u (the larger end of each link) and its smaller neighbours are linked to the least of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(floor.select("u", F.col("m").alias("v"))).distinct()
        edges = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
        now = _marks(edges)
        if now == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        before = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
