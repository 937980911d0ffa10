"""Token overlap and TF-IDF cosine of text pairs, in long form and linear in the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, normalize_text, term_tokens, tokenize, with_bigrams
from tessera.sources.shared import materialize

MIN_DF, MAX_DF = 3, 0.9
#: Sums count whole numbers, 2^-22 and 2^-44 apart, in longs: all terms that an array holds fit.
STEP = float(1 << 22)
#: Cosines are multiples of 2^-42, which is more than the sums' parts and the division change.
GRID = float(1 << 42)


def add_pair_texts(pairs: DataFrame, query: str, item: str) -> DataFrame:
    """Adds ``q_norm``, ``i_norm`` and their Jaccard similarity ``jac``."""
    out = pairs.withColumns({"q_norm": normalize_text(F.col(query)), "i_norm": normalize_text(F.col(item))})
    return out.withColumn("jac", jaccard(tokenize(F.col("q_norm")), tokenize(F.col("i_norm"))))


def pair_terms(pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id, term, tf_q, tf_i``: counts of each unigram and bigram in a pair's two texts.

    Both sides share a row, so a pair's dot product never leaves its own key. The words of each
    text are cut once, in a projection of their own, and one scan yields both sides' terms.
    """
    words = pairs.select(F.col(row_id).alias("row_id"), term_tokens(F.col("q_norm")).alias("q"), term_tokens(F.col("i_norm")).alias("i"))
    grams = words.select("row_id", with_bigrams(F.col("q")).alias("q"), with_bigrams(F.col("i")).alias("i"))
    terms = grams.select("row_id", F.size("q").alias("n_q"), F.posexplode(F.concat("q", "i")).alias("at", "term"))
    return terms.groupBy("row_id", "term").agg(F.count_if(F.col("at") < F.col("n_q")).alias("tf_q"), F.count_if(F.col("at") >= F.col("n_q")).alias("tf_i"))


def corpus_size(pairs: DataFrame) -> DataFrame:
    """One row: how many texts the pairs have."""
    return pairs.agg((2 * F.count(F.lit(1))).alias("n_docs"))


def vocabulary(terms: DataFrame, size: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``term, df, idf`` of the terms in at least min_df texts and at most max_df of them.

    Frequent terms go before any join, which bounds its skew. idf is smoothed, plus one.
    """
    df = terms.groupBy("term").agg(F.sum((F.col("tf_q") > 0).cast("long") + (F.col("tf_i") > 0).cast("long")).alias("df"))
    kept = df.crossJoin(F.broadcast(size)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    return kept.select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``row_id, term, w_q, w_i``: tf times idf, before any scaling."""
    return terms.join(vocab, "term").select("row_id", "term", (F.col("tf_q") * F.col("idf")).alias("w_q"), (F.col("tf_i") * F.col("idf")).alias("w_i"))


def exact_sum(x: Column) -> Column:
    """Sum of numbers from 0, to 2^-44 each, that is the same in any order."""
    whole = F.floor(x)
    rest = (x - whole) * STEP
    part = F.floor(rest)
    return F.sum(whole) + (F.sum(part) + F.sum(F.rint((rest - part) * STEP).cast("long")) / STEP) / STEP


def cosine(pairs: DataFrame, row_id: str = "row_id", min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``row_id, tfidf_cos`` for the rows whose two texts both keep a term; others have cosine 0.

    The terms are cut and counted once, and written for the vocabulary and the weights. Equal cosines
    are equal numbers, whatever the order of the sums: a threshold is often some rows' own cosine, and
    the rules must not part such rows. Texts of equal terms have cosine 1.
    """
    terms = materialize(pair_terms(pairs, row_id), "pair-terms")
    w = weights(terms, vocabulary(terms, corpus_size(pairs), min_df, max_df))
    product = lambda a, b: exact_sum(F.col(a) * F.col(b))
    sums = w.groupBy("row_id").agg(product("w_q", "w_i").alias("dot"), product("w_q", "w_q").alias("q"), product("w_i", "w_i").alias("i"))
    cos = F.col("dot") / F.sqrt(F.col("q") * F.col("i"))
    return sums.where("q > 0 and i > 0").select("row_id", (F.rint(cos * GRID) / GRID).alias("tfidf_cos"))


def add_cosine(pairs: DataFrame, row_id: str = "row_id", min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``pairs`` with ``tfidf_cos``; row_id must be unique. No shared term: 0."""
    found = cosine(pairs, row_id, min_df, max_df).withColumnRenamed("row_id", "_cos_id")
    cos: Column = F.coalesce(F.col("tfidf_cos"), F.lit(0.0))
    return pairs.join(found, F.col(row_id) == F.col("_cos_id"), "left").drop("_cos_id").withColumn("tfidf_cos", cos)
