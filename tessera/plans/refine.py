"""The refinement pipeline: similarities, predictions, thresholds, suspects, clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import similarity, suspects
from tessera.operators.relational import project_common, valid_rows
from tessera.sources.shared import materialize

ITEM = {"QI": "item_title", "QC": "category_path"}


def item_column(task: str) -> str:
    if task.upper() not in ITEM:
        raise ValueError("task must be QI or QC")
    return ITEM[task.upper()]


def similarities(pairs: DataFrame, task: str, row_id: str = "id") -> DataFrame:
    """Valid rows with both similarities. Row ids must be unique.

    The normalized texts are written once: term weights and the rules read them.
    """
    item = item_column(task)
    rows = similarity.add_pair_texts(valid_rows(pairs, item), "origin_query", item)
    return similarity.add_cosine(materialize(rows, "pair-texts"), row_id)


def predictions(preds: DataFrame) -> DataFrame:
    """``id, pred, prob1`` of prediction rows, whose probability may come from logits."""
    has = set(preds.columns)
    logit = lambda i: F.get("logits", F.lit(i)) if "logits" in has else F.lit(None).cast("double")
    given = F.col("prob1").cast("double") if "prob1" in has else F.lit(None).cast("double")
    return preds.select(F.col("id").cast("string").alias("id"), F.col("prediction").cast("int").alias("pred"), suspects.prob1(given, logit(0), logit(1)).alias("prob1"))


def join_predictions(rows: DataFrame, preds: DataFrame | None) -> DataFrame:
    """Left join by id: several predictions of one id make several rows; none is a disagreement."""
    if preds is None:
        return rows.withColumns({"pred": F.lit(None).cast("int"), "prob1": F.lit(None).cast("double"), "disagree": F.lit(False)})
    joined = rows.join(predictions(preds), "id", "left")
    return joined.withColumn("disagree", suspects.disagrees(F.col("label"), F.col("pred")))


def largest_class(pairs: DataFrame) -> int:
    """Rows of the largest language and label."""
    return pairs.groupBy("language", "label").count().agg(F.max("count")).first()[0] or 0


def flagged(pairs: DataFrame, preds: DataFrame | None, task: str = "QI", autotune: bool = True, min_support: int = suspects.MIN_SUPPORT, row_id: str = "id", task_rows: int = suspects.TASK_ROWS) -> DataFrame:
    """Every valid row with its similarities, thresholds and both flags.

    Quantiles are taken after the prediction join, so its extra rows count. The joined rows are
    written once, for the quantiles and for the rules. Whether one task may take a language's
    quantiles is decided by the size of its largest class; either way gives the same numbers.
    """
    rows = materialize(join_predictions(similarities(pairs, task, row_id), preds), "similarities")
    by_rank = autotune and largest_class(rows) > task_rows
    found = suspects.thresholds(rows, autotune, min_support, by_rank)
    return suspects.add_suspects(suspects.add_thresholds(rows, found))


def refine(pairs: DataFrame, preds: DataFrame | None, task: str = "QI", autotune: bool = True, min_support: int = suspects.MIN_SUPPORT, row_id: str = "id") -> DataFrame:
    """The clean rows: ``id, language, origin_query, item_title or category_path, label``."""
    rows = flagged(pairs, preds, task, autotune, min_support, row_id).where(~F.col("suspect_with_pred"))
    return project_common(rows, item_column(task))
