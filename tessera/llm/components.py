"""Connected components of an edge table by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import release

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: its size and the sum of its rows' hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``id, root`` for each id of ``edges(a, b)``: root is the smallest id of its component.

    Large-star and small-star rounds alternate until the edges are stars and stay so. Minima are
    aggregated before they meet the edges again in a join, so no task gathers a hub's neighbours.
    Each round's edges are written to the shared folder, which cuts the lineage.
    """
    found = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name
    )
    state = _state(found)
    for _ in range(rounds):
        both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > k").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large["a"] == low["k"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, found = found, materialize(small.select("e.a", "e.b").where("a > b").distinct(), name)
        release(before)
        now = _state(found)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return found.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").unionAll(
        found.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
