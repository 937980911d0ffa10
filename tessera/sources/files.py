"""JSON sources and sinks of the engine, on any path that Spark reads."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "QC": "id string, task string, language string, origin_query string, query string, category_path string, label string",
    "QI": "id string, task string, language string, lang string, origin_query string, query string, q string, item_title string, i string, label string",
    "predictions": "id string, prediction int, prob1 double, logprob_yes double, logprob_no double, logits array<double>",
}


def file_order() -> Column:
    """Where a scanned row stands: file, block of the file, and place within.

    Tasks take blocks by size, so row numbers alone don't follow the files. To be selected right at
    the scan; it orders rows, but does not count them.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def read_lines(spark: SparkSession, path: str, order: str) -> DataFrame:
    """``value`` of each line that isn't blank, and its place in file order as ``order``."""
    return spark.read.text(path).select("value", file_order().alias(order)).where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False, tolerant: bool = False, order: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, or refused if ``strict``.

    A malformed line fails the job, or is left out if ``tolerant`` (a writer that was cut off leaves
    half a line). ``order`` names a column for the place in file order.
    """
    if strict:
        lines = spark.read.text(path).withColumn(
            "value", F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value"))
        )
        parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
        return parsed.select("r.*")
    reader = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.select("*", file_order().alias(order)) if order else rows


def read_optional_jsonl(spark: SparkSession, path: str | None, schema: str, tolerant: bool = False, order: str | None = None) -> DataFrame:
    """As ``read_jsonl``; without a path, or where there is no such file, an empty table."""
    if path:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return read_jsonl(spark, path, schema, tolerant=tolerant, order=order)
        spark._jvm.org.apache.log4j.LogManager.getLogger("tessera").warn(f"{path} is missing: taken as empty")
    empty = spark.createDataFrame([], schema)
    return empty.withColumn(order, F.lit(None).cast("struct<file:string,block:long,n:long>")) if order else empty


def read_json_array(spark: SparkSession, path: str, schema: str | None = None, order: str | None = None) -> DataFrame:
    """Files that hold one JSON array of objects each, whatever their ending."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.select("*", file_order().alias(order)) if order else rows


def key_present(raw: Column, key: str) -> Column:
    """Whether a raw JSON object has the key at all: a null value is not a missing key."""
    return F.array_contains(F.json_object_keys(raw), key)


def present_or(raw: Column, first: str, second: str, default: str) -> Column:
    """``first`` if its key is there, else ``second``; null and empty values become the default."""
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    return F.coalesce(F.nullif(F.when(key_present(raw, first), at(first)).otherwise(at(second)), F.lit("")), F.lit(default))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line; nulls are written, letters beyond ASCII stay as they are."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes to."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json_arrays(df: DataFrame, path: str, indent: int = 0) -> None:
    """Each part of the rows as a text file that is one JSON array, written by its task."""

    def bracketed(batches):
        before = "["
        for pdf in batches:
            lines = [f"{',' if i or before != '[' else '['}{indented(x, indent)}" for i, x in enumerate(pdf["value"])]
            if lines:
                before = ","
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if before == "[" else "]"]})

    objects = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    objects.mapInPandas(bracketed, "value string").write.mode("overwrite").text(path)


def indented(text: str, indent: int) -> str:
    """A JSON object on lines of its own, or as it is without an indent."""
    if not indent:
        return text
    pretty = json.dumps(json.loads(text), indent=indent, ensure_ascii=False)
    return "\n" + "\n".join(" " * indent + x for x in pretty.splitlines())


def summary(spark: SparkSession, **fields) -> DataFrame:
    """A one-row table of run figures."""
    return spark.createDataFrame([json.dumps(fields)], "string").select(F.col("value").alias("summary"))
