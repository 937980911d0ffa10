"""Similarities, thresholds, rules, splits, ids and masks."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import similarity as S
from tessera.operators import suspects as U
from tessera.plans import refine


def python_cosine(pairs, min_df, max_df):
    def terms(t):
        w = re.findall(r"(?u)\b\w\w+\b", t)
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    docs = [terms(a) for a, _ in pairs] + [terms(b) for _, b in pairs]
    n = len(docs)
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if min_df <= c <= max_df * n}
    vec = [{t: c * idf[t] for t, c in d.items() if t in idf} for d in docs]
    length = [math.sqrt(sum(v * v for v in d.values())) for d in vec]
    out = []
    for i in range(len(pairs)):
        j = i + len(pairs)
        dot = sum(v * vec[j].get(t, 0) for t, v in vec[i].items())
        out.append(dot / length[i] / length[j] if length[i] and length[j] else 0.0)
    return out


def test_cosine_by_hand(spark):
    pairs = [("aa bb", "aa cc"), ("bb cc", "bb"), ("", ""), ("aa bb cc dd", "dd a/b aa"), ("zz", "yy")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_id long, q_norm string, i_norm string")
    got = [r["tfidf_cos"] for r in S.add_cosine(df, min_df=2).orderBy("row_id").collect()]
    assert got == pytest.approx(python_cosine(pairs, 2, 0.9))


def test_equal_cosines_are_equal_numbers(spark):
    words = [[f"w{(i * 7 + j * j) % 83}" for j in range(40 + i)] for i in range(60)]
    pairs = [(" ".join(w), " ".join(w[::-1] * (1 + i % 3))) for i, w in enumerate(words)]
    same = [(" ".join(w), " ".join(w)) for w in words]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs * 2 + same)], "row_id long, q_norm string, i_norm string")
    runs = [[r["tfidf_cos"] for r in S.add_cosine(df.repartition(n)).orderBy("row_id").collect()] for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]  # to the last bit, whatever the order of the sums
    assert runs[0][:60] == runs[0][60:120]
    assert set(runs[0][120:]) == {1.0}


def test_copies_get_the_same_flags(spark):
    """The threshold is the copies' own cosine, 1: rounding must not part them."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 83}" for j in range(40 + i)) for i in range(120)]
    rows = [(str(i), "en", t, f"{t}!!", "0") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, language string, origin_query string, item_title string, label string")
    df = df.withColumn("item_title", F.concat("item_title", F.lit(" x y z x/y/z")))  # words of one letter are no terms, but part Jaccard
    got = refine.flagged(df, None).select("tfidf_cos", "hi_cos", "suspect_no_pred").collect()
    assert {tuple(r) for r in got} == {(1.0, 1.0, True)}


def test_idf_value(spark):
    df = spark.createDataFrame([(0, "aa bb", "aa")], "row_id long, q_norm string, i_norm string")
    terms = S.pair_terms(df)
    rows = {r["term"]: r["idf"] for r in S.vocabulary(terms, S.corpus_size(df), 1, 1.0).collect()}
    assert rows == {"aa": pytest.approx(1.0), "bb": pytest.approx(math.log(1.5) + 1), "aa bb": pytest.approx(math.log(1.5) + 1)}


def test_thresholds(spark):
    rows = [("en", "0", i / 100, i / 200) for i in range(101)] + [("en", "1", 0.5, 0.5)] + [("de", "0", 0.9, 0.9), (None, "0", 0.1, 0.1)]
    df = spark.createDataFrame(rows, "language string, label string, tfidf_cos double, jac double")
    got = {r["language"]: r.asDict() for r in U.thresholds(df).collect()}
    assert set(got) == {"en", "de"}
    assert got["en"]["hi_cos"] == pytest.approx(0.9) and got["en"]["lo_cos"] == 0.12
    assert got["de"]["hi_cos"] == 0.35 and got["de"]["hi_jac"] == 0.2
    tuned = U.thresholds(df, min_support=1)
    assert {r["language"]: r["lo_cos"] for r in tuned.collect()}["en"] == 0.35  # cut at the upper default
    joined = U.add_thresholds(df, U.thresholds(df)).where("language is null").first()
    assert (joined["hi_cos"], joined["lo_jac"]) == (0.35, 0.05)


def test_quantiles_by_rank(spark):
    rows = [(x, str(i % 2), ((i * 37) % 101) / 7, (i * 13 % 11) / 3) for i in range(203) for x in ("en", "de", None)] + [("one", "1", 0.5, 0.25)]
    df = spark.createDataFrame(rows, "language string, label string, tfidf_cos double, jac double")
    take = lambda d: sorted((r["language"], r["n0"], r["n1"], *[None if r[c] is None else round(r[c], 9) for c in ("q_hi_cos", "q_hi_jac", "q_lo_cos", "q_lo_jac")]) for r in d.collect())
    assert take(U.quantiles_by_rank(df)) == take(U.quantiles(df))


def test_large_classes_go_by_rank(spark):
    rows = [(str(i), "en", f"red lamp {i % 9}", f"lamp {i % 7} red", str(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, language string, origin_query string, item_title string, label string")
    flags = lambda n: sorted((r["id"], r["suspect_with_pred"]) for r in refine.flagged(df, None, task_rows=n).collect())
    assert flags(10) == flags(10_000)


def flag(spark, **values):
    row = {"label": "0", "tfidf_cos": 0.0, "jac": 0.0, "q_norm": "a", "i_norm": "b", "disagree": False, "prob1": None} | U.DEFAULTS | values
    schema = ", ".join(f"{k} {'string' if k in ('label', 'q_norm', 'i_norm') else 'boolean' if k == 'disagree' else 'double'}" for k in row)
    got = U.add_suspects(spark.createDataFrame([tuple(row.values())], schema)).first()
    return got["suspect_no_pred"], got["suspect_with_pred"]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({}, (False, False)), ({"tfidf_cos": 0.35}, (True, True)), ({"label": "1"}, (True, True)),
        ({"label": "1", "jac": 0.05}, (False, False)), ({"disagree": True}, (False, True)), ({"prob1": 0.9}, (False, True)),
        ({"label": "1", "jac": 0.5, "prob1": 0.1}, (False, True)), ({"jac": 0.185, "i_norm": "x 1/64 y"}, (True, True)),
        ({"jac": 0.185, "i_norm": "x 11/64 y"}, (False, False)), ({"label": "1", "jac": 0.054, "q_norm": "10 f"}, (True, True)),
    ],
)
def test_rules(spark, values, expected):
    assert flag(spark, **values) == expected


def test_votes(spark):
    rows = [("a", 1, float("nan"), None), ("b", 0, None, [0.0, 2.0]), ("c", 0, None, None)]
    df = spark.createDataFrame(rows, "id string, prediction int, prob1 double, logits array<double>")
    got = {r["id"]: r["prob1"] for r in refine.predictions(df).collect()}
    assert got == {"a": None, "b": pytest.approx(0.880797, abs=1e-6), "c": None}
    pairs = spark.createDataFrame([("a", "1"), ("a2", "0"), ("b", "1")], "id string, label string")
    rows = {r["id"]: r["disagree"] for r in refine.join_predictions(pairs, df).collect()}
    assert rows == {"a": False, "a2": True, "b": True}
    twice = refine.join_predictions(pairs, df.unionAll(df)).where("id = 'a'")
    assert twice.count() == 2


def test_valid_rows(spark):
    rows = [("1", "q", "t", x) for x in ("1", "0", "1.0", "true", None)] + [("1", "", "", "1"), ("1", None, "t", "1")]
    df = spark.createDataFrame(rows, "id string, origin_query string, item_title string, label string")
    assert sorted(r["label"] for r in R.valid_rows(df, "item_title").collect()) == ["0", "1", "1"]


def test_last_path_wins(spark):
    rows = [("QC", " Red  Lamp", "a,b", 0), ("QC", "red lamp", "a, Big C", 1), ("QC", "red lamp", "", 2), ("QI", "x", "y", 3)]
    qc = spark.createDataFrame(rows, "task string, origin_query string, category_path string, line_no long")
    lookup = R.query_leaf_map(qc)
    assert [tuple(r) for r in lookup.collect()] == [("red lamp", "a, Big C")]
    df = spark.createDataFrame([("RED LAMP",), ("y",)], "origin_query string")
    assert sorted((r["origin_query"], r["qc_leaf"]) for r in R.add_query_leaf(df, lookup).collect()) == [("RED LAMP", "big_c"), ("y", None)]


def test_positions_and_resume(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.lit(999) - F.col("id")).alias("k"))
    assert [(r["k"], r["position"]) for r in R.positional_id(df, "k").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    done = spark.createDataFrame([(1,), (1,), (5,)], "k long")
    assert R.not_done(df, done, "k").count() == 998


def test_stratified_split(spark):
    df = spark.range(103).select("id", F.when(F.col("id") % 4 == 0, "yes").otherwise("no").alias("output"))
    out = R.stratified_split(df, "output").cache()
    sizes = {(r["output"], r["split"]): r["count"] for r in out.groupBy("output", "split").count().collect()}
    assert sum(n for (_, s), n in sizes.items() if s == "test") == math.ceil(0.2 * 103)
    assert sizes[("yes", "test")] in (5, 6) and out.count() == 103
    again = R.stratified_split(df.repartition(5), "output")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_masks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2), ([1], 5), ([], 0)], "ids array<int>, n int")
    got = [r["m"] for r in df.select(R.mask_prompt(F.col("ids"), F.col("n")).alias("m")).collect()]
    assert got == [[-100, -100, 3, 4], [-100], []]
    cut = [r["c"] for r in df.select(R.truncate_with_end(F.col("ids"), 3, 0).alias("c")).collect()]
    assert cut == [[1, 2, 3], [1, 0], [0]]
    padded = [r["p"] for r in df.select(R.pad_right(F.col("ids"), 9, 4).alias("p")).collect()]
    assert padded == [[1, 2, 3, 4], [1, 9, 9, 9], []]


def test_f1(spark):
    df = spark.createDataFrame([("1", 1), ("1", 0), ("0", 1), ("0", 0)], "label string, prediction int")
    assert U.f1(df).first()["f1"] == pytest.approx(0.5)
    assert U.f1(df.where("label = '0' and prediction = 0")).first()["f1"] == 0.0
    df = spark.createDataFrame([(0.0, 0.0), (-math.inf, -math.inf)], "a double, b double")
    p = [r["p"] for r in df.select(U.prob_from_logprobs(F.col("a"), F.col("b")).alias("p")).collect()]
    assert p[0] == 0.5 and math.isnan(p[1])
