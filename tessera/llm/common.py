"""What the operators of this subpackage share: tables, scratch space, row keys and order."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import materialize, shared_path as scratch_path  # noqa: F401

#: Six ASCII white-space characters; a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Hand freed memory back to the system: a worker that waits for its next task keeps it else."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """A partition function that releases memory when its partition is done."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by which buckets are sized."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``rid, doc_id, text``: rid is unique and in the order of (doc_id, nulls last, then text).

    With ``whole`` a fourth column ``row`` holds all columns of docs.

    Where doc_id is unique and never null it is rid itself, at the price of one narrow count.
    Otherwise rows are range-sorted once and numbered; equal rows get different numbers, so the
    first of them stays the earliest.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    if whole:
        columns.append(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    slim = docs.select(*columns)
    names = slim.columns
    n, seen, distinct = (
        slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n"), F.count("doc_id"), F.count(F.lit(1))).first()
    )
    if (n or 0) == seen == distinct:
        # The filter holds for all rows; said here, every join sees one and the same exchange.
        return slim.where("doc_id is not null").select(F.col("doc_id").alias("rid"), *names)
    # The last key only spreads rows that are equal otherwise over several ranges.
    ordered = slim.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text"), F.monotonically_increasing_id())
    return materialize(ordered.select(F.monotonically_increasing_id().alias("rid"), *names), "keyed")


def running_sums(df: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """Range-sort by ``order`` and add ``before_<c>``: the sum of c over all rows before.

    ``_pos`` rises in that order. Sums are of longs.

    No global window: each sorted part is summed by itself, and the parts' totals (one row for
    each partition) are carried on through the driver. ``df`` should hold narrow rows.
    """
    spark = df.sparkSession
    flat = materialize(df.orderBy(*order, F.monotonically_increasing_id()).select("*", F.monotonically_increasing_id().alias("_pos")), name)
    flat = flat.withColumn("_part", F.shiftright("_pos", 33))
    totals = flat.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("_part").collect()
    base: list[tuple] = []
    run = [0] * len(sums)
    for row in totals:
        base.append((row["_part"], *run))
        run = [a + (row[c] or 0) for a, c in zip(run, sums)]
    schema = ", ".join(["_part long", *[f"_base_{c} long" for c in sums]])
    bases = F.broadcast(spark.createDataFrame(base, schema))  # a row for each sorted partition
    before = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = flat.join(bases, "_part")
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("_part", *[f"_base_{c}" for c in sums])
