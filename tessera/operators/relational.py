"""Lookups, splits, ids and masks around the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import falsy, leaf_category, normalize_query
from tessera.sources.shared import materialize

#: Fixed multiplier of the portable hash that orders rows at random but the same everywhere.
HASH = 2654435761


def project_common(df: DataFrame, item: str) -> DataFrame:
    """``id, language, origin_query, <item>, label`` as strings."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("id", "language", "origin_query", item, "label")])


def valid_rows(df: DataFrame, item: str) -> DataFrame:
    """Rows without nulls in query, item and label, and with a label of 0 or 1. Empty texts stay."""
    return df.na.drop(subset=["origin_query", item, "label"]).where(F.col("label").isin("0", "1"))


def query_leaf_map(qc: DataFrame, order: str = "line_no") -> DataFrame:
    """``query, category_path``: of each normalized query the last path in file order."""
    rows = qc.where("task = 'QC'").select(normalize_query(F.col("origin_query")).alias("query"), "category_path", F.col(order).alias("_at"))
    rows = rows.where((F.col("query") != "") & falsy(F.col("category_path")).isNotNull())
    return rows.groupBy("query").agg(F.max_by("category_path", "_at").alias("category_path"))


def add_query_leaf(df: DataFrame, lookup: DataFrame, query: str = "origin_query") -> DataFrame:
    """``qc_leaf``: the leaf category of the row's query in the lookup, or null.

    The side to broadcast is left to the optimizer, which knows the sizes at run time.
    """
    right = lookup.select(F.col("query").alias("_query"), leaf_category(F.col("category_path")).alias("qc_leaf"))
    return df.join(right, normalize_query(F.col(query)) == F.col("_query"), "left").drop("_query")


def not_done(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key isn't in ``done`` yet, to resume an append."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def positional_id(df: DataFrame, *order: str) -> DataFrame:
    """``position`` from 1 in the given order, without one task for all rows.

    The sorted rows are written to the shared folder, so that their parts stay as they are; each
    part is counted, and its rows are numbered from its start. Hand over narrow rows.
    """
    spark = df.sparkSession
    flat = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "positions")
    flat = flat.withColumn("_part", F.shiftright("_at", 33))
    base, starts = 0, []
    for row in flat.groupBy("_part").count().orderBy("_part").collect():  # a row for each part
        starts.append((row["_part"], base))
        base += row["count"]
    starts = spark.createDataFrame(starts, "_part long, _base long")
    within = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return flat.join(F.broadcast(starts), "_part").withColumn("position", F.col("_base") + within + 1).drop("_at", "_part", "_base")


def portable_hash(key: Column, seed: int = 42) -> Column:
    """(key + seed) * HASH modulo 2**32: the same in any engine."""
    return F.pmod((key.cast("long") + seed) * HASH, F.lit(1 << 32))


def seeded_order(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """``shuffle_key``, by which (and by the key) rows are in a seeded random order."""
    return df.withColumn("shuffle_key", portable_hash(F.col(key), seed))


def stratified_split(df: DataFrame, stratum: str, key: str = "id", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` (train or test): test has ceil(share * n) rows, dealt to strata by their sizes.

    Strata get the floor of their share, the rest goes to the largest remainders (ties: smaller
    stratum first). Within a stratum the rows of the smallest hash are the test. Keys must be
    unique. Only the strata's sizes meet in windows; rows are numbered by a range sort of
    (stratum, hash, key), so a stratum with most rows is spread over tasks.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()
    total = F.sum("_n").over(everything)
    wanted = F.ceil(total * test_share)
    quota = F.col("_n") * wanted / total
    by_name = Window.orderBy(F.col(stratum).asc_nulls_first())
    shares = sizes.withColumn("_floor", F.floor(quota)).withColumn("_rest", quota - F.floor(quota)).withColumn("_left", wanted - F.sum(F.floor(quota)).over(everything))
    extra = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(stratum).asc_nulls_first()))
    start = F.coalesce(F.sum("_n").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select(F.col(stratum).alias("_s"), (F.col("_floor") + (extra <= F.col("_left")).cast("long")).alias("_test"), start.alias("_start"))
    keys = df.select(F.col(stratum).alias("_s"), portable_hash(F.col(key), seed).alias("_h"), F.col(key).alias("_k"))
    ranked = positional_id(keys, "_s", "_h", "_k").withColumnRenamed("_s", "_t")
    tests = ranked.join(shares, F.col("_t").eqNullSafe(F.col("_s"))).select("_k", (F.col("position") - F.col("_start") <= F.col("_test")).alias("_is"))
    joined = df.join(tests, df[key] == tests["_k"], "left")
    return joined.withColumn("split", F.when(F.col("_is"), "test").otherwise("train")).drop("_k", "_is")


def mask_prompt(ids: Column, prompt_length: Column, ignored: int = -100) -> Column:
    """Labels of a token row: the prompt's are ignored, the rest are the ids."""
    n = F.least(prompt_length, F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignored), n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))


def loss_ids(labels: Column, ignored: int = -100) -> Column:
    return F.filter(labels, lambda x: x != ignored)


def truncate_with_end(ids: Column, cutoff: int, end_id: int) -> Column:
    """The first ``cutoff`` ids, with the end id appended where there is room and none yet."""
    cut = F.slice(ids, 1, cutoff)
    open_end = (F.size(cut) < cutoff) & ~F.coalesce(F.try_element_at(cut, F.lit(-1)) == end_id, F.lit(False))
    return F.when(open_end, F.concat(cut, F.array(F.lit(end_id)))).otherwise(cut)


def pad_to(ids: Column, length: Column, fill: int = 0) -> Column:
    """The ids with fill values up to a length."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(length - F.size(ids), F.lit(0))))


def pad_right(ids: Column, fill: int = 0, multiple: int = 8) -> Column:
    """The ids with fill values up to the next multiple of a length."""
    return pad_to(ids, F.size(ids) + F.pmod(-F.size(ids), F.lit(multiple)), fill)
