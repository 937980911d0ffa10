"""Quality, decontamination, the Jaccard join, components and the pipeline."""

import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, quality
from tessera.llm.components import connected_components
from tests.conftest import tables_dir
from tests.llm.cases import ODD, documents, ordered, texts, thue_morse


def brute_join(rows, threshold=0.8, gram=5):
    """{position: (class position, links)} over rows in order."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        n = min(gram, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(rows))], links


@pytest.mark.parametrize("block", [2048, 4])
def test_join(spark, block):
    rows = list(enumerate(texts(9, 80)))
    roots, links = brute_join(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(documents(spark, rows), block=block).collect()}
    assert got == {i: (roots[i], links[i]) for i in range(len(rows))}
    assert max(links) > 10


def test_join_odd(spark):
    got = jaccard_join.jaccard_join(documents(spark, ODD)).collect()
    rows = ordered(ODD)
    _, links = brute_join(rows)
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=repr) == sorted(((d, n) for (d, _), n in zip(rows, links)), key=repr)
    assert jaccard_join.jaccard_join(documents(spark, [])).count() == 0
    kept = jaccard_join.keep_one_each(documents(spark, ODD))
    assert kept.columns == documents(spark, ODD).columns
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted(["", "", "", "a b c " * 40, "q w e r t " * 30])


def test_join_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables_dir()}/documents.parquet").orderBy("doc_id").collect()]
    roots, links = brute_join(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.op5_jaccard_join(spark, tables_dir()).collect()}
    assert got == {rows[i][0]: (rows[roots[i]][0], links[i]) for i in range(len(rows))}


def test_boilerplate_chains(spark):
    """A chain of documents, each half its neighbour's, is no class; small groups within it are."""
    rng = random.Random(6)
    piece = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(60))
    pieces = [piece() for _ in range(161)]
    rows = [f"{pieces[i]} {pieces[i + 1]}" for i in range(160)]
    common = piece()
    rows += [f"{common} {piece()}" for _ in range(40)]  # boilerplate of a half
    rows += [rows[i] + " a few more words" for i in range(0, 160, 20)]
    rows = list(enumerate(rows))
    roots, links = brute_join(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(documents(spark, rows), block=16).collect()}
    assert got == {i: (roots[i], links[i]) for i in range(len(rows))} and sum(links) == 16


def test_sketches_part_chains():
    """Sketches join no pair of a chain of halves or of sixty in a hundred, and every pair at the threshold."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    for n in (40, 120, 300, 2000):
        met = {}
        for j in (0.33, 0.8):
            met[j] = 0
            for _ in range(200):
                own = round(n * 2 * j / (1 + j) + 0.5)
                both, a, b = draw(own), draw(n - own), draw(n - own)
                sets = [np.unique(np.concatenate([both, x])) for x in (a, b)]
                sketches = [np.unique((np.sort(jaccard_join.R.mix(s))[: jaccard_join.SKETCH] >> np.uint64(32)).astype(np.uint32)) for s in sets]
                met[j] += jaccard_join._alike(sketches, np.array([len(s) for s in sets]), 0.8)[1] == 0
        assert met == {0.33: 0, 0.8: 200}, n


@pytest.mark.parametrize("n", [12, 60, 250, 1500])
def test_recall_at_sizes(n):
    """Pairs at the threshold, equal in size, meet in a leaf whatever their size."""
    rng = np.random.default_rng(n)
    runs, met = jaccard_join.runs_for(), 0
    for _ in range(400):
        own = -(-n * 16 // 18)
        tokens = rng.integers(0, 2**63, 2 * n - own, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(tokens[:n]), np.sort(np.concatenate([tokens[:own], tokens[n:]]))
        met += bool(set(jaccard_join.leaves(a, 0.8, 4, runs)) & set(jaccard_join.leaves(b, 0.8, 4, runs)))
    assert met >= 396


def test_words_of_one_polynomial_hash(spark):
    x, y = thue_morse(10)
    rows = [(1, f"{x} one two three four"), (2, f"{y} one two three four"), (3, x), (4, y)]
    assert {r["n_links"] for r in jaccard_join.jaccard_join(documents(spark, rows)).collect()} == {0}


def test_join_of_long_texts(spark):
    """Texts of a hundred thousand words, one a near copy of the other."""
    words = [f"w{i * 7919 % 100_003}" for i in range(100_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[::-1])), (4, "w1 w2")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(documents(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_recall_of_paths():
    """Pairs just over the threshold share a leaf about as often as planned."""
    rng = np.random.default_rng(0)
    runs = jaccard_join.runs_for()
    met = 0
    for _ in range(300):
        tokens = rng.integers(0, 2**63, 240, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(tokens[:220]), np.sort(np.concatenate([tokens[:195], tokens[220:240]]))
        met += bool(set(jaccard_join.leaves(a, 0.8, 4, runs)) & set(jaccard_join.leaves(b, 0.8, 4, runs)))
    assert met >= 297


def test_recall_of_contained_pairs():
    """A set within another, at exactly the threshold, is found as often as promised."""
    rng = np.random.default_rng(1)
    runs, trials = jaccard_join.runs_for(), 6000
    met = 0
    for _ in range(trials):
        tokens = rng.integers(0, 2**63, 250, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(tokens), np.sort(tokens[:200])
        met += bool(set(jaccard_join.leaves(a, 0.8, 4, runs)) & set(jaccard_join.leaves(b, 0.8, 4, runs)))
    # Six misses are expected; 15 would be four standard deviations beyond.
    assert runs == 19 and trials - met <= 15


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    up = {x: x for e in edges for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    bench = [(i, f"{text(rng.randint(8, 90))}? {text(6)}. {text(5)}.") for i in range(60)] + [(60, None), (61, "!"), (None, "one two three four five six seven."), (63, "Yes.")]
    docs, want = [], set()
    for d in range(120):
        body = [text(rng.randint(5, 400))]
        if d % 3 == 0:
            i = rng.randrange(60)
            body.insert(0, text(rng.randint(0, 300)))
            body.insert(1, bench[i][1].upper() if d % 2 else bench[i][1])
            want.add((d, i))
        docs.append((d, "\n".join(body)))
    docs += [(500, None), (501, ""), (502, "ONE two, three four five six seven")]
    want.add((502, None))
    got = decontaminate.find_leaks(documents(spark, docs), items(spark, bench)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["score"] >= decontaminate.RETRIEVE - 1e-9 and r["answer_overlap"] == 1.0 for r in got)
    left = decontaminate.drop_leaks(documents(spark, docs), items(spark, bench))
    assert left.columns == documents(spark, docs).columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert {r["leak"] for r in got} == {"item"}
    assert decontaminate.find_leaks(documents(spark, docs), items(spark, [])).count() == 0
    assert decontaminate.find_leaks(documents(spark, []), items(spark, bench)).count() == 0


def test_scores_of_any_number_of_indexes(spark, tmp_path):
    """Weights, passages and so every figure are the same however many files hold the items."""
    rng = random.Random(8)
    word = lambda: f"v{int(rng.paretovariate(0.6)) % 900}"
    text = lambda k: " ".join(word() for _ in range(k))
    bench = [(i, f"{text(rng.randint(6, 140))}? {text(6)}.") for i in range(70)] + [(None, None), (71, "")]
    docs = [(d, text(rng.randint(0, 500)) + "\n" + bench[rng.randrange(70)][1] + text(rng.randint(0, 300))) for d in range(60)]
    found = []
    for n, chars in ((1, 1 << 30), (2, 20_000), (7, 3_000)):
        paths = decontaminate.write_indexes(items(spark, bench), f"file://{tmp_path}/{n}", chars)
        assert len(paths) >= n
        got = decontaminate.find_leaks(documents(spark, docs), items(spark, bench), shard_chars=chars).collect()
        found.append(sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["question_overlap"], r["leak"]) for r in got))
        left = decontaminate.drop_leaks(documents(spark, docs), items(spark, bench), shard_chars=chars)
        assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {r[0] for r in found[-1]}
    assert len(found[0]) >= 60 and found[0] == found[1] == found[2]


def test_long_items_and_texts():
    """An item of 20,000 words, a text of half a million: bounded steps, and short items still found."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 3000, n))
    long, short = text(20_000), text(30)
    index = decontaminate.Index([(1, long)] + [(i, text(25)) for i in range(2, 400)])
    tracemalloc.start()
    ids = index.numbers(decontaminate.words_of(text(300) + " " + long))
    assert any(index.hopeful(rows, 0.6).any() for rows in index.passages(ids))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    small = decontaminate.Index([(7, short)])
    assert [m[0] for m in small.matches(text(250_000) + " " + short + " " + text(250_000))] == [7]


def test_question_without_answer(spark):
    bench = [(1, "one two three four five six seven eight? nine ten eleven twelve thirteen fourteen.")]
    docs = [(1, "x one two three four five six seven eight y"), (2, "x " + bench[0][1]), (3, "nine ten eleven twelve thirteen fourteen")]
    got = {r["doc_id"]: (r["leak"], r["question_overlap"], r["answer_overlap"]) for r in decontaminate.find_leaks(documents(spark, docs), items(spark, bench)).collect()}
    assert got == {1: ("question", 1.0, 0.0), 2: ("item", 1.0, 1.0)}


def test_question_only_leaks(spark):
    """Questions without their answers, whole, with a word edited, or in two far places."""
    bench = [(b["item_id"], b["text"]) for b in spark.read.parquet(f"{tables_dir('sf0.1')}/benchmark.parquet").collect()]
    questions = {i: decontaminate.question_and_answer(t)[0] for i, t in bench}
    questions = {i: q for i, q in questions.items() if len(q) >= decontaminate.GRAM}
    docs, fill = [], [f"zz{i}" for i in range(400)]
    for q in questions.values():
        k = len(q) // 2
        for words in (q, [*q[:k], "edited", *q[k + 1 :]], [*q[: k + 2], *fill, *q[k - 2 :]]):
            docs.append((len(docs), " ".join([*fill[:30], *words, *fill[:50]])))
    want = {}
    for d, t in docs:
        have = decontaminate.grams(decontaminate.words_of(t))
        for i, q in questions.items():
            own = decontaminate.grams(q)
            if len(own & have) / len(own) >= 0.8:
                want[d, i] = len(own & have) / len(own)
    got = decontaminate.find_leaks(documents(spark, docs), items(spark, bench)).collect()
    got = {(r["doc_id"], r["item_id"]): (r["question_overlap"], r["score"]) for r in got if r["item_id"] in questions}
    assert {k: v for k, (v, _) in got.items()} == want
    assert len(want) > 2 * len(questions) and min(s for _, s in got.values()) < decontaminate.RETRIEVE
    left = decontaminate.drop_leaks(documents(spark, docs), items(spark, bench))
    assert {d for d, _ in docs} - {r["doc_id"] for r in left.collect()} >= {d for d, _ in want}


def test_wand_is_exact():
    """Block-max WAND finds what scoring every item finds, and bounds are bounds."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    pick = lambda k: " ".join(rng.choice(words[: rng.choice([8, 60])]) for _ in range(k))
    index = decontaminate.Index([(i, pick(rng.randint(1, 30))) for i in range(80)])
    for _ in range(150):
        terms = list({index.terms[w] for w in pick(rng.randint(1, 40)).split() if w in index.terms})
        scores = {}
        for t in terms:
            p = index.postings[t]
            for n, s in zip(p.items, p.impacts):
                scores[n] = scores.get(n, 0.0) + s
        threshold = rng.choice([0.1, 0.3, 0.6, 0.9])
        want = {n: s for n, s in scores.items() if s >= threshold - 1e-9}
        got = index.wand(terms, threshold)
        assert got == pytest.approx(want)
        if want:
            row = np.array([[*terms]])
            assert index.hopeful(row, threshold)[0]


def test_planted_items(spark):
    """Every document that holds a whole item, and no other, in the given tables."""
    bench = spark.read.parquet(f"{tables_dir()}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{tables_dir()}/documents.parquet").collect()
    own = [(b["item_id"], decontaminate.grams(decontaminate.words_of(b["text"]))) for b in bench]
    want = set()
    for d in docs:
        have = decontaminate.grams(decontaminate.words_of(d["text"]))
        want |= {(d["doc_id"], i) for i, g in own if g and len(g & have) / len(g) > 0.9}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op3_decontaminate(spark, tables_dir()).collect()}
    assert got == want


def test_quality_held_out(spark):
    """Fitted on half the labels, the classifier parts the other half."""
    d = tables_dir("sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    half = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    got = quality.score(docs, labels.where(half)).join(labels.where(~half), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert len(good) > 50 and sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.15


def test_quality_cases(spark):
    rows = [(i, "fine words in a plain line of text." if i % 3 else "$$ ### @@@ %%% ^^ $$$") for i in range(90)] + ODD
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    keep = {r["doc_id"]: r["keep"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 10}
    assert all(k == bool(i % 3) for i, k in keep.items())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got)
    nothing = quality.score(docs, labels.where("false")).collect()
    assert all(r["keep"] and r["evidence"] == 0 for r in nothing)
    assert quality.score(docs.where("false"), labels).count() == 0 and quality.keep_good(docs.where("false"), labels).count() == 0


def brute_posteriors(rows):
    """For each row (site, path, p) the log odds that the other rows of its path and site add."""
    sites, paths = {}, {}
    for s, t, p in rows:
        for at, k in ((sites, s), (paths, (s, t))):
            n, total = at.get(k, (0, 0.0))
            at[k] = n + 1, total + p
    m = sum(x for _, x in sites.values()) / len(rows)

    def weight(groups):
        noise = sum(q * (1 - q) for _, _, q in groups)
        spread = sum(n * (x / n - q) ** 2 for n, x, q in groups)
        room = sum((n - 1) * q * (1 - q) for n, _, q in groups)
        return min(max(room / (spread - noise) - 1, 5.0), 1000.0) if spread > noise else 1000.0

    sw = weight([(n, x, m) for n, x in sites.values()])
    site_mean = lambda s, n=0, p=0.0: (sites[s][1] - p + sw * m) / (sites[s][0] - n + sw)
    pw = weight([(n, x, site_mean(s)) for (s, _), (n, x) in paths.items()])
    odds = lambda x: np.log(max(x, 1e-6) / max(1 - x, 1e-6))
    out = []
    for s, t, p in rows:
        n, x = paths[s, t]
        out.append(odds((x - p + pw * site_mean(s, 1, p)) / (n - 1 + pw)) - odds(m))
    return out


def test_posteriors_against_brute_force(spark):
    """p_good of every row: its own evidence and what others of its site and path say."""
    rows = list(enumerate(texts(12, 120))) + ODD
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(len(t or "") % 3 > 0), 0) for i, t in rows[:80]], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    kept = [r.asDict() for r in docs.collect()]
    evidence = [float(model.log_odds([r["text"]])[0]) for r in kept]
    p = [1 / (1 + np.exp(-e)) for e in evidence]
    shifts = brute_posteriors([(r["source"] or "", r["lang"] or "", x) for r, x in zip(kept, p)])
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(e, 6), round(float(s), 6), e + s >= 0) for r, e, s in zip(kept, evidence, shifts))
    got = quality.score(docs, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["evidence"], 6), round(r["site_shift"], 6), r["keep"]) for r in got) == want
    for most in (1 << 20, 0):  # paths broadcast, or not
        left = quality.keep_good(docs, labels, most=most)
        assert sorted(map(repr, left.collect())) == sorted(map(repr, quality.keep_good(docs, labels).collect()))
        assert left.count() == sum(w[-1] for w in want)


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: (r["evidence"], r["site_shift"], r["p_good"], r["keep"]) for r in quality.op2_quality(spark, tables_dir()).collect()}
    docs, labels = (spark.read.parquet(f"{tables_dir()}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.collect()
    evidence = [float(model.log_odds([r["text"]])[0]) for r in rows]
    shifts = brute_posteriors([(r["source"] or "", r["lang"] or "", 1 / (1 + np.exp(-e))) for r, e in zip(rows, evidence)])
    assert len(got) == len(rows)
    for r, e, s in zip(rows, evidence, shifts):
        assert got[r["doc_id"]][:3] == pytest.approx((e, s, 1 / (1 + np.exp(-e - s))), abs=1e-6) and got[r["doc_id"]][3] == (e + s >= 0)


def test_fit_is_bounded(spark, monkeypatch):
    """Repeated doc_ids make no more rows of the fit than were asked for."""
    rows = [(i % 3, f"some words {i} here") for i in range(300)] + [(i, "other words") for i in range(3, 40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    sizes = []
    start = quality.Classifier.__init__
    monkeypatch.setattr(quality.Classifier, "__init__", lambda self, telling, x, y, ridge=1.0: (sizes.append(len(x)), start(self, telling, x, y, ridge))[1])
    quality.fit(documents(spark, rows), labels, rows=3)
    quality.fit(documents(spark, rows), labels)
    assert sizes == [3, 40]


def test_quality_of_long_texts(spark):
    rows = [(i, "fine words in a plain line of text. " * (20_000 if i == 1 else 3) if i % 3 else "$$ ### @@@ %%% ^^ $$$ " * (20_000 if i == 3 else 3)) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["keep"] for r in quality.score(documents(spark, rows), labels).collect()} == {i: bool(i % 3) for i in range(90)}


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("new", "a", 0.1)]
    got = {r["_site"]: r["shift"] for r in quality.site_posteriors(spark.createDataFrame(rows, "_site string, _path string, _p double")).collect()}
    assert got["bad"] < got["new"] < got["big"]


def brute_pipeline(spark, folder):
    """The rows of every stage by plain Python, but for the classifier and the sampling, which are tested by themselves."""
    import zlib

    from tokenizers import Tokenizer

    from tessera.llm.mixing import plan_mix
    from tessera.llm.token_output import default_tokenizer

    docs, labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [r.asDict() for r in docs.collect()]
    model = quality.fit(docs, labels)
    evidence = [float(model.log_odds([r["text"]])[0]) for r in rows]
    shifts = brute_posteriors([(r["source"] or "", r["lang"] or "", 1 / (1 + np.exp(-e))) for r, e in zip(rows, evidence)]) if rows else []
    rows = [r for r, e, s in zip(rows, evidence, shifts) if e + s >= 0]
    sizes = [len(rows)]
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode()))
    roots, _ = brute_join([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    sizes.append(len(rows))
    questions = [decontaminate.grams(decontaminate.question_and_answer(b["text"])[0]) for b in bench.collect()]
    questions = [q for q in questions if q and len(next(iter(q))) == 5]
    have = [decontaminate.grams(decontaminate.words_of(r["text"])) for r in rows]
    rows = [r for r, h in zip(rows, have) if not any(len(q & h) >= 0.8 * len(q) - 1e-9 for q in questions)]
    sizes.append(len(rows))
    left = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    copies = sorted((p["doc_id"] is None, p["doc_id"] or 0, p["copies"], p["size"]) for p in plan_mix(left).collect())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r["text"] or "")
    plain, out, start = Tokenizer.from_file(default_tokenizer()), [], 0
    for none, i, n, size in copies:
        i = None if none else i
        assert len(set(by_id[i])) == 1  # the tables below have no two texts left of one id
        for _ in range(n):
            ids = np.array([*plain.encode(by_id[i][0], add_special_tokens=False).ids, 2], "<u4")
            out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return sizes, out


def small_tables(spark, folder, rows):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i, _ in rows if i is not None] + [(None, 0, 0), (3, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, rows[5][1] if len(rows) > 5 else "a b c d e f g. h."), (2, None), (None, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("case", ["tables", "odd", "empty"])
def test_pipeline(spark, case, tmp_path):
    """The rows of every stage, and the ids at the end, as plain Python gives them."""
    import corpus_pipeline

    rows = [] if case == "empty" else [(i, t) for i, t in enumerate(texts(2, 40)) if i != 6] + [(None, "a b c d e f g " * 9), (0, None), (8, ""), (40, None)]
    folder = tables_dir() if case == "tables" else small_tables(spark, tmp_path / "t", rows)
    if case == "odd":  # a null text and an empty one share an id with another text: give them their own
        rows = [(i + 1000 if t in (None, "") and i is not None else i, t) for i, t in rows]
        folder = small_tables(spark, tmp_path / "u", [*dict.fromkeys(rows), rows[9], rows[9]])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept, counts = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == columns, name
        counts.append(kept.count())
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    sizes, want = brute_pipeline(spark, folder)
    assert counts[:3] == sizes
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want and counts[3] == len(want)
    assert case == "empty" or counts[0] > counts[1] > counts[2] > 0


def test_the_rest_stands_alone():
    """Nothing else imports this subpackage, and the entry works without it."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'tessera.llm' or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
import tessera.cli, tessera.models, tessera.streaming.stateless
assert len(e.queries()) > 60 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
