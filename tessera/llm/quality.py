"""Quality by hierarchical empirical Bayes: a document's own evidence on top of its site's rate.

A logistic classifier over text features gives each document log odds under the corpus-wide rate.
Sites (hosts) and their paths (sections) get beta posteriors from grouped sums of those
probabilities, each level shrunk towards the one above with a weight estimated from the spread of
its groups; sparse sites stay at the global prior. A document's own probability is taken out of its
site's and path's sums, so that it counts once. Bayes' rule then swaps the corpus-wide prior odds
for those of the document's path.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, table

#: Labelled rows that the classifier is fitted on, at most: those of the smallest hash.
FIT_ROWS = 20_000
#: What a word needs to be one that tells bad documents; FIT_ROWS bounds how many there can be.
MIN_BAD, MIN_Z = 8, 5.0
THRESHOLD = 0.5
MIN_WEIGHT, MAX_WEIGHT = 5.0, 1000.0
#: Bytes of sites and paths (their names and some numbers each) up to which they are broadcast.
BROADCAST_BYTES = 8 << 20
NAMES = ("words", "variety", "repeats", "length", "symbols", "pipes", "digits", "stops", "lines", "told", "told_share", "letters")

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_SYMBOLS = bytes(c for c in _PUNCTUATION if chr(c) not in ".,;:!?'\"-()|")
_DIGITS = b"0123456789"


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return (text or "").lower().encode().translate(_TO_SPACE).split()


def features(text: str | None, telling: frozenset) -> list[float]:
    """The numbers of NAMES; zeros for an empty text."""
    data = (text or "").encode()
    words = plain_words(text)
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(data)
    kinds = set(words)
    told = kinds & telling
    gone = lambda chars: (size - len(data.translate(None, chars))) / size
    return [
        np.log1p(n), np.log1p(len(kinds)) / np.log1p(n), sum(a == b for a, b in pairwise(words)) / n, sum(map(len, words)) / n,
        gone(_SYMBOLS), data.count(b"|") / n, gone(_DIGITS), min(1.0, data.count(b".") / n), min(1.0, data.count(b"\n") / n),
        min(5.0, len(told)), len(told) / len(kinds), 1 - gone(_PUNCTUATION),
    ]


class Classifier:
    """Ridge logistic regression on standardized features; ``telling`` words count as one."""

    def __init__(self, telling: frozenset, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.telling = telling
        self.mean = x.mean(0) if len(x) else np.zeros(len(NAMES))
        self.scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(NAMES))
        z = self._design(x)
        self.beta = np.zeros(z.shape[1])
        pull = ridge * np.eye(z.shape[1])
        pull[0, 0] = 1e-3
        for _ in range(30):
            if not len(x):
                break
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pull, z.T @ (y - p) - pull @ self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.reshape(-1, len(NAMES)) - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def log_odds(self, texts) -> np.ndarray:
        x = np.array([features(t, self.telling) for t in texts], float).reshape(-1, len(NAMES))
        return np.clip(self._design(x) @ self.beta, -15, 15)


def _word_counts(batches):
    counts: dict[bytes, list[int]] = {}
    for pdf in batches:
        for text, good in pdf[["text", "good"]].itertuples(index=False, name=None):
            for w in set(plain_words(text)):
                counts.setdefault(w, [0, 0])[int(good)] += 1
    yield pd.DataFrame([(w.decode(), bad, good) for w, (bad, good) in counts.items()], columns=["word", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents, those whose doc_id has the smallest hash.

    Good is quality 1 and not toxic; several labels of one document: good only if all are; several
    documents of one doc_id: the text that sorts first. So the rows of the fit, not only its ids,
    are at most ``rows``. The bounded sample of labels is broadcast; the driver gets the features of
    the fit's rows, and the words that tell.
    """
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    marks = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), good.alias("good"))
    sample = marks.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = materialize(sample, "quality-sample")
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    chosen = materialize(chosen.groupBy("id", "good").agg(F.min("text").alias("text")), "quality-fit")
    n = {r["good"]: r["count"] for r in chosen.groupBy("good").count().collect()}
    bad, fine = n.get(0, 0), n.get(1, 0)
    words = chosen.mapInPandas(_word_counts, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (F.col("bad") + F.col("good")) / float(max(1, bad + fine))
    z = (F.col("bad") - bad * share) / F.sqrt(bad * share * (1 - share) + 1e-9)
    telling = words.withColumn("z", z).where((F.col("bad") >= MIN_BAD) & (F.col("z") >= MIN_Z) & (F.col("bad") > 9 * F.col("good")))
    telling = frozenset(r["word"].encode() for r in telling.collect())

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t, telling) for t in pdf["text"]], "good": pdf["good"], "id": pdf["id"]})

    found = chosen.mapInPandas(measure, "x array<double>, good int, id long").orderBy("id", "good", "x").collect()
    x = np.array([r["x"] for r in found], float).reshape(-1, len(NAMES))
    return Classifier(telling, x, np.array([r["good"] for r in found], float))


def _weight(mean: Column, parent: Column, n: Column) -> Column:
    """Prior weight of a level by moments of its groups' rates, within bounds."""
    noise = F.sum(parent * (1 - parent))
    spread = F.sum(n * (mean - parent) * (mean - parent))
    room = F.sum((n - 1) * parent * (1 - parent))
    weight = F.when(spread > noise, room / (spread - noise) - 1).otherwise(F.lit(MAX_WEIGHT))
    return F.coalesce(F.least(F.greatest(weight, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT)), F.lit(MAX_WEIGHT))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """``_site, _path, _n, _s, _sn, _ss, _m, _sw, _pw, shift``: a row for each path.

    ``scored(_site, _path, _p)`` is summed by path first, so a site with a third of all documents
    costs its few path rows: ``_n`` documents of a path and the sum ``_s`` of their probabilities,
    ``_sn`` and ``_ss`` of its site, the overall mean ``_m``, and the weights of the site's and the
    path's prior. ``shift`` is the log odds that the path adds to a document from elsewhere. One-row
    tables are the only broadcasts asked for.
    """
    paths = scored.groupBy("_site", "_path").agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_s"))
    paths = materialize(paths, "quality-paths")
    sites = paths.groupBy("_site").agg(F.sum("_n").alias("_sn"), F.sum("_s").alias("_ss"))
    overall = sites.agg((F.sum("_ss") / F.sum("_sn")).alias("_m"))
    sites = sites.crossJoin(F.broadcast(overall))
    site_weight = sites.agg(_weight(F.col("_ss") / F.col("_sn"), F.col("_m"), F.col("_sn")).alias("_sw"))
    joined = paths.join(sites.crossJoin(F.broadcast(site_weight)), "_site")
    path_weight = joined.agg(_weight(F.col("_s") / F.col("_n"), _site_mean(), F.col("_n")).alias("_pw"))
    names = ("_site", "_path", "_n", "_s", "_sn", "_ss", "_m", "_sw", "_pw")
    return materialize(joined.crossJoin(F.broadcast(path_weight)).select(*names, _shift(F.lit(0), F.lit(0.0)).alias("shift")), "quality-posteriors")


def _site_mean(n=0, p=0.0) -> Column:
    """The site's posterior mean without n documents whose probabilities sum to p."""
    return (F.col("_ss") - p + F.col("_sw") * F.col("_m")) / (F.col("_sn") - n + F.col("_sw"))


def _shift(n: Column, p: Column) -> Column:
    """Log odds of the path's posterior mean over the overall mean's, without n documents of sum p."""
    mean = (F.col("_s") - p + F.col("_pw") * _site_mean(n, p)) / (F.col("_n") - n + F.col("_pw"))
    odds = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    return odds(mean) - odds(F.col("_m"))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _evidence(model: Classifier):
    @F.pandas_udf("double")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.log_odds(texts))
        release_memory()

    return evidence


def _posteriors(rows: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The paths of ``rows(_site, _path, _e)``, to be broadcast if their measured size allows."""
    found = site_posteriors(rows.select("_site", "_path", _sigmoid(F.col("_e")).alias("_p"))).drop("shift")
    size = found.agg(F.sum(F.octet_length("_site") + F.octet_length("_path") + 80)).first()[0] or 0
    return (F.broadcast(found), True) if size <= most else (found, False)


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``_shift`` and ``_p_good`` to rows."""
    joined = rows.join(found, ["_site", "_path"]).withColumn("_shift", _shift(F.lit(1), _sigmoid(F.col("_e"))))
    return joined.withColumn("_p_good", _sigmoid(F.col("_e") + F.col("_shift")))


def _named(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, site: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, evidence, site_shift, p_good, keep``: one row for each row of ``docs``.

    ``site`` and ``path`` name the columns that say where a document comes from: its host, and the
    section under it. Texts are read for the fit's rows and once for all; only narrow rows go on.

    * null site or path: one like any other, named by the empty string. null or empty text: all
      features are 0, judged by the fit and the site. null doc_id: kept, never labelled.
    * labels that are null count for nothing; no labels at all: evidence 0, everything is kept.
    * repeated rows are judged each; empty docs: no rows. Other columns are ignored. Very long texts
      are judged whole.
    """
    model = fit(docs, labels, fit_rows)
    rows = docs.select("doc_id", _named(site).alias("_site"), _named(path).alias("_path"), _evidence(model)(F.col("text")).alias("_e"))
    rows = materialize(rows, "quality-scores")
    judged = _judged(rows, _posteriors(rows)[0])
    return judged.select("doc_id", F.col("_e").alias("evidence"), F.col("_shift").alias("site_shift"), F.col("_p_good").alias("p_good"), (F.col("_p_good") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, site: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, all columns as they are; see there for odd rows.

    Rows are written once with their evidence and a number, so the classifier runs once. With few
    sites and paths the rows are filtered where they lie, else by the numbers of those that stay.
    """
    model = fit(docs, labels, fit_rows)
    whole = docs.select(
        F.monotonically_increasing_id().alias("_rid"), _named(site).alias("_site"), _named(path).alias("_path"),
        _evidence(model)(F.col("text")).alias("_e"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    )
    whole = materialize(whole, "quality-rows")
    narrow = whole.select("_rid", "_site", "_path", "_e")
    found, small = _posteriors(narrow, most)
    if small:
        return _judged(whole, found).where(F.col("_p_good") >= threshold).select("_row.*")
    kept = _judged(narrow, found).where(F.col("_p_good") >= threshold)
    return whole.join(kept.select("_rid"), "_rid", "left_semi").select("_row.*")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
