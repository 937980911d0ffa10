"""The corpus pipeline: stages over ``documents``, each one an operator of ``tessera.llm``.

1. quality        documents that the quality classifier rejects go
2. near_copies    one document of each Jaccard class stays, the earliest
3. leaks          documents that leak a benchmark item go
4. mix            sources are sampled to their target weights; a document may come several times
5. tokens         texts become token ids in files; the rows are what is read back from them

All stages but the last return the columns of ``documents``. Null ids, null and empty texts, repeated
rows, extra columns and empty tables go through as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize, scratch_path, table
from tessera.llm.decontaminate import drop_leaks
from tessera.llm.jaccard_join import keep_one_each
from tessera.llm.mixing import mix
from tessera.llm.quality import keep_good
from tessera.llm.token_output import tokenized
from tessera.sources.shared import release, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that ``keep_good`` keeps; null or empty texts are judged by the fit and their site."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest row of each class; rows without words, null or empty, link to nothing and stay."""
    return keep_one_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item; null and empty texts stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them; null sources are one source."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files of ids, read back; a null text is its end id alone."""
    return tokenized(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("mix", mixed), ("tokens", tokens)]

#: Classifier fitting, random paths and token ids are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written before the next reads them.

    What a stage wrote on its way, and the rows that it read, are removed once its own are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
