"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.session import forget, stored

_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns node and label from links a, b: label is the smallest node of the component.

    Large-star and small-star steps (Kiveris et al. 2014) in turn until the links no longer change: each step connects
    neighbours to the smallest node nearby, by one aggregation and one join on the node, so a node with very many links
    is pre-aggregated and its rows can be split. Each round's links are written to the shared scratch folder, and removed after the next one.
    """
    now = stored(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _state(now)
    for _ in range(_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Each node with its own smallest neighbour is kept by the small-star step.
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        forget(last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
