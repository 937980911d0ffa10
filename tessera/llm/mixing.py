"""Mixing sources to target weights by systematic sampling.

Every document's expected copies (its source's target over its source's size) are summed in order
within the source, shifted by one random offset for each source; a document is emitted once for
each integer that its own stretch of the sum crosses. Documents are ordered by size, so what a
source yields differs from its target by the size of about one document.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, running_sums, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
#: Expected copies are whole numbers of 1/UNIT, so that sums are exact and in any order the same.
UNIT = 1 << 40
#: Offsets of neighbouring sources lie a golden section apart; the first one comes from the seed.
STEP = 679_547_305_813
SOURCES = 1 << 22


def first_offset(seed: int) -> int:
    return random.Random(seed).getrandbits(40)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """``source, source_size, target, expected, offset``: one row for each source.

    ``sizes(source, size)``. Sources in order of code points, null last, take the weights in turn.
    All sizes together are shared out by weight; no target is over ``most`` times its source's
    size, and what that cuts off is reshared among the rest by weight until none is above. In
    order of size over weight the cut sources come first, so one pass over the sources' running
    sums settles it; ranks and sums are those of range sorts, so there may be any number of sources.
    """
    scale = 2.0 ** (40 - math.ceil(math.log2(max(weights))))  # weights as whole numbers: sums are exact
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one"], "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(round(w * scale)).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.col("before_one").alias("rank")).withColumn("weight", weight)
    full = F.col("source_size") * most / (F.col("weight") / scale)
    shared = running_sums(ranked.withColumn("full", full), ["full", "rank"], ["source_size", "weight"], "mix-levels")
    everything = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    left = F.col("all_size") - most * F.col("before_source_size")
    shared = shared.crossJoin(F.broadcast(everything)).withColumn("level", left / ((F.col("all_weight") - F.col("before_weight")) / scale))
    shared = shared.withColumn("cut", F.col("level") > F.col("full"))
    level = shared.where(~F.col("cut")).agg(F.min_by("level", F.struct("full", "rank")).alias("_level"))
    target = F.when(F.col("cut"), (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") / scale * F.col("_level"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        shared.crossJoin(F.broadcast(level)).withColumn("target", target)
        .withColumn("expected", F.floor(rate * UNIT + 0.5).cast("long"))
        .select("source", "source_size", "target", "expected", F.pmod(F.col("rank") % SOURCES * STEP + first_offset(seed), F.lit(UNIT)).alias("offset"))
    )


def plan_mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """``source, doc_id, size, tie, source_size, target, copies``: one row for each row of docs.

    Texts are read once, for their size and a hash that orders equal sizes and ids; only these
    narrow rows are sorted. See ``mix`` for the edge cases.
    """
    rows = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"),
    )
    sizes = materialize(rows, "mix-sizes")
    targets = materialize(source_targets(sizes, weights, most, seed), "mix-targets")
    expected = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        sizes["source"], "doc_id", "size", "tie", "source_size", "target", "expected", "offset", F.lit(1).cast("long").alias("one")
    )
    order = [F.col("source").asc_nulls_last(), "size", F.col("doc_id").asc_nulls_last(), "tie"]
    summed = running_sums(expected, order, ["one"], "mix-order")
    starts = summed.groupBy(F.col("source").alias("s")).agg(F.min("before_one").alias("start"))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("s")))
    # A source's documents expect the same, so the sum before one is a product: exact as a decimal.
    whole = lambda n: n.cast("decimal(19,0)") * F.col("expected").cast("decimal(18,0)") + F.col("offset").cast("decimal(18,0)")
    crossed = lambda n: F.call_function("div", whole(n), F.lit(UNIT).cast("decimal(18,0)"))
    rank = F.col("before_one") - F.col("start")
    copies = crossed(rank + 1) - crossed(rank)
    return placed.select("source", "doc_id", "size", "tie", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of docs.

    * A null source is a source of its own, the last; a null text has size 0. Documents of size 0
      are taken like any other of their source but add no words; a source of size 0 gives nothing.
    * A null doc_id sorts last; equal rows are sampled each for itself.
    * Empty table: no rows. Other columns pass through, whatever their names.
    * Reruns agree: order, offsets and sums depend on the rows and the seed alone.
    """
    names = docs.columns
    prefix = "_mix_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    keys = {"source": F.col("source").cast("string"), "doc_id": F.col("doc_id").cast("long"), "tie": F.xxhash64("text")}
    same = Window.partitionBy(*[prefix + k for k in keys]).orderBy(prefix + "tie")
    left = docs.withColumns({prefix + k: c for k, c in keys.items()}).withColumn(prefix + "n", F.row_number().over(same))
    plan = plan_mix(docs, weights, most, seed).where("copies > 0")
    right = plan.select(*[F.col(k).alias("r_" + k) for k in keys], F.col("copies").cast("int").alias("r_copies"))
    right = right.withColumn("r_n", F.row_number().over(Window.partitionBy(*["r_" + k for k in keys]).orderBy(F.col("r_copies").desc())))
    match = F.lit(True)
    for k in [*keys, "n"]:
        match &= left[prefix + k].eqNullSafe(right["r_" + k])
    joined = left.join(right, match).withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), F.col("r_copies"))))
    return joined.select(*[left[n] for n in names])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 2e0 ELSE 3e0 END AS weight FROM ranked),
filled AS (SELECT *, source_size * 3 / weight AS filled FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY filled, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY filled, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM filled),
targets AS (
  SELECT source, source_size, rank,
    CASE WHEN level > filled THEN (source_size * 3)::DOUBLE ELSE weight * (SELECT arg_min(level, (filled, rank)) FROM levels WHERE NOT level > filled) END AS target
  FROM levels),
expected AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT} + 0.5)::BIGINT ELSE 0 END AS e, (rank * {STEP} + {OFFSET}) % {UNIT} AS shift FROM targets),
placed AS (
  SELECT s.*, x.source_size, x.target, x.e, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) * x.e::HUGEINT + shift AS upto
  FROM sizes s JOIN expected x ON s.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, ((upto // {UNIT} - (upto - e) // {UNIT}) * size)::BIGINT AS taken FROM placed
""".replace("{UNIT}", str(UNIT)).replace("{STEP}", str(STEP)).replace("{OFFSET}", str(first_offset(0)))
