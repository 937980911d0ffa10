"""Label-noise detection: thresholds for each language, and rules that only ever set a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import positional_id

# Terms that mislead a scorer, and default thresholds.
FP_TERMS = (
    r"\b1/64\b", r"\b1:64\b", r"\bfigure\b", r"\bdiecast\b", r"\bpgm\b", r"\brwb\b",
    r"\bconverter\b", r"\badapter\b", r"\b75mm\b", r"\b12v\b", r"\b220v\b", r"\btransformer\b",
)
FN_TERMS = (
    r"\binch\b", r"\bmonitor\b", r"\bcapacitor\b", r"\b(u|µ)?f\b", r"\bm(ah|a)\b",
    r"\b4k\b", r"\b128gb\b", r"\bgame\s*stick\b", r"\bhdmi\b", r"\bvga\b",
)
DEFAULTS = {"hi_cos": 0.35, "hi_jac": 0.20, "lo_cos": 0.12, "lo_jac": 0.05}
P_HI, P_LO = 0.90, 0.10
MIN_SUPPORT = 100
#: Rows of a language and label whose exact quantiles one task may take; more go by rank, with the
#: same result.
TASK_ROWS = 1 << 22


def any_term(text: Column, patterns) -> Column:
    """One alternation of all patterns, with Unicode classes."""
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def quantiles(rows: DataFrame) -> DataFrame:
    """For each language the exact 0.9 quantile of label 0 and the 0.1 quantile of label 1."""
    pick = lambda c, label, p: F.percentile(F.when(F.col("label") == label, F.col(c)), p)
    return rows.where("language is not null").groupBy("language").agg(
        F.count_if(F.col("label") == "0").alias("n0"), F.count_if(F.col("label") == "1").alias("n1"),
        pick("tfidf_cos", "0", P_HI).alias("q_hi_cos"), pick("jac", "0", P_HI).alias("q_hi_jac"),
        pick("tfidf_cos", "1", P_LO).alias("q_lo_cos"), pick("jac", "1", P_LO).alias("q_lo_jac"),
    )


def quantiles_by_rank(rows: DataFrame) -> DataFrame:
    """The same as ``quantiles``, exact too, from ranks of a range sort.

    ``percentile`` keeps a language's distinct values in one task; here a value is a narrow row
    that any task may hold, and only the two rows around a quantile are looked at.
    """
    measures = F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("v")) for m, c in (("cos", "tfidf_cos"), ("jac", "jac"))])
    values = rows.where("language is not null").select("language", "label", F.explode(measures).alias("x")).select("language", "label", "x.m", "x.v")
    placed = positional_id(values, "language", "label", "m", "v")
    keys = ["language", "label", "m"]
    at = (F.col("n") - 1) * F.when(F.col("label") == "0", F.lit(P_HI)).otherwise(F.lit(P_LO))
    groups = placed.groupBy(*keys).agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("at", at)
    near = placed.join(groups, keys).withColumn("step", F.col("position") - F.col("first") - F.floor("at")).where("step in (0, 1)")
    low, high = (F.max(F.when(F.col("step") == i, F.col("v"))) for i in (0, 1))
    place = F.any_value("at")  # the same interpolation as percentile's, to the last bit
    between = (F.floor(place) + 1 - place) * low + (place - F.floor(place)) * high
    found = near.groupBy(*keys).agg(F.any_value("n").alias("n"), F.when(F.coalesce(high, low) == low, low).otherwise(between).alias("q"))
    pick = lambda c, label, m="cos": F.max(F.when((F.col("label") == label) & (F.col("m") == m), F.col(c)))
    return found.groupBy("language").agg(
        F.coalesce(pick("n", "0"), F.lit(0)).alias("n0"), F.coalesce(pick("n", "1"), F.lit(0)).alias("n1"),
        pick("q", "0").alias("q_hi_cos"), pick("q", "0", "jac").alias("q_hi_jac"), pick("q", "1").alias("q_lo_cos"), pick("q", "1", "jac").alias("q_lo_jac"),
    )


def thresholds(rows: DataFrame, autotune: bool = True, min_support: int = MIN_SUPPORT, by_rank: bool = False) -> DataFrame:
    """``language, hi_cos, hi_jac, lo_cos, lo_jac``.

    A class under ``min_support`` rows takes the defaults. The upper bounds are at least 0.6 of
    their default, the lower ones at most the *upper* bounds' default. Null languages have none.
    ``by_rank``: for groups whose distinct values are too many for one task.
    """
    if not autotune:
        return rows.select("language").where("language is not null").distinct().select("language", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()])

    def tuned(name: str) -> Column:
        high = name.startswith("hi")
        value = F.when(F.col("n0" if high else "n1") >= min_support, F.col(f"q_{name}")).otherwise(F.lit(DEFAULTS[name]))
        upper = DEFAULTS["hi" + name[2:]]
        return (F.greatest(value, F.lit(upper * 0.6)) if high else F.least(value, F.lit(upper))).alias(name)

    found = quantiles_by_rank(rows) if by_rank else quantiles(rows)
    return found.select("language", *[tuned(k) for k in DEFAULTS])


def add_thresholds(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with its language's thresholds; unknown and null languages get the defaults."""
    right = found.withColumnRenamed("language", "_language")
    joined = rows.join(right, rows["language"] == right["_language"], "left").drop("_language")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})


def prob1(prob: Column, logit0: Column, logit1: Column) -> Column:
    """The probability given, else the softmax of two logits, else null. NaN means no vote."""
    top = F.greatest(logit0, logit1)
    e0, e1 = F.exp(logit0 - top), F.exp(logit1 - top)
    return F.coalesce(F.nanvl(prob, F.lit(None).cast("double")), e1 / (e0 + e1 + 1e-12))


def prob_from_logprobs(yes: Column, no: Column) -> Column:
    """Softmax of two log probabilities; two infinities give NaN, as 0 / 0."""
    top = F.greatest(yes, no)
    e1, e0 = F.exp(yes - top), F.exp(no - top)
    return e1 / (e1 + e0)


def disagrees(label: Column, pred: Column) -> Column:
    """Label against prediction; a missing prediction counts as disagreement."""
    return ~label.cast("int").eqNullSafe(pred.cast("int"))


def base_suspect() -> Column:
    high = (F.col("tfidf_cos") >= F.col("hi_cos")) | (F.col("jac") >= F.col("hi_jac"))
    low = (F.col("tfidf_cos") < F.col("lo_cos")) & (F.col("jac") < F.col("lo_jac"))
    return F.when(F.col("label") == "0", high).otherwise(low)


def bias_suspect() -> Column:
    """The base rule, tightened or loosened where misleading terms stand in either text."""
    text = F.concat(F.col("q_norm"), F.lit(" || "), F.col("i_norm"))
    near = lambda c, hi: F.col(c) >= F.greatest(F.col(hi) * 0.9, F.col(hi) - 0.02)
    far = lambda c, lo: F.col(c) < F.col(lo) * 1.1
    fp = any_term(text, FP_TERMS) & (near("tfidf_cos", "hi_cos") | near("jac", "hi_jac"))
    fn = any_term(text, FN_TERMS) & far("tfidf_cos", "lo_cos") & far("jac", "lo_jac")
    return F.when(F.col("label") == "0", fp).otherwise(fn)


def vote_suspect(disagree: Column, prob: Column) -> Column:
    sure = F.when(F.col("label") == "0", prob >= 0.9).otherwise((F.col("label") == "1") & (prob <= 0.1))
    return disagree | F.coalesce(sure, F.lit(False))


def add_suspects(rows: DataFrame, with_predictions: bool = True) -> DataFrame:
    """``suspect_no_pred`` and ``suspect_with_pred``, as one projection.

    Needs the similarities, the thresholds and, with predictions, ``disagree`` and ``prob1``.
    """
    plain = base_suspect() | bias_suspect()
    voted = plain | vote_suspect(F.col("disagree"), F.col("prob1")) if with_predictions else plain
    return rows.withColumns({"suspect_no_pred": plain, "suspect_with_pred": voted})


def report(flagged: DataFrame) -> DataFrame:
    """Rows and suspects by label, with and without predictions."""
    return flagged.groupBy("label").agg(
        F.count("id").alias("n"), F.sum(F.col("suspect_with_pred").cast("long")).alias("sus_with_pred"),
        F.sum(F.col("suspect_no_pred").cast("long")).alias("sus_no_pred"),
    ).withColumn("diff", F.col("sus_with_pred") - F.col("sus_no_pred"))


def f1(rows: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row with the F1 score of class 1; 0 where it is undefined."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    tp, fp, fn = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))
    return rows.agg(F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"))
