"""The row-wise operators over a stream of JSON lines. Nothing here keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import category_depth_tags, lang_tag
from tessera.operators.similarity import add_pair_texts


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def tag_categories(rows: DataFrame) -> DataFrame:
    """Queries with their language and category paths with their depths, in place."""
    return rows.withColumns({"origin_query": lang_tag(F.col("language"), F.col("origin_query")), "category_path": category_depth_tags(F.col("category_path"))})


def similarity(rows: DataFrame, item: str = "item_title") -> DataFrame:
    return add_pair_texts(rows, "origin_query", item)


def append_jsonl(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch as JSON lines; a restart goes on where the checkpoint says."""
    return stream.writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
