"""Repeated windows and strings against brute force; the suffix sorter against a dictionary."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm import rolling as R
from tessera.llm.substring_dedup import Words, op8_substring_dedup, remove_repeated_windows
from tessera.llm.suffix_dedup import Bytes, difference_cover, equal_strings, op6_suffix_array_dedup, remove_repeated_strings
from tests.conftest import tables_dir
from tests.llm.cases import ODD, documents, ordered, texts, thue_morse


def brute(rows, units, length):
    """(id, units, kept units, maximal removed runs) by a dictionary of all windows."""
    seen, out = set(), []
    for i, t in ordered(rows):
        u = units(t or "")
        gone = [False] * len(u)
        for a in range(len(u) - length + 1):
            w = tuple(u[a : a + length])
            if w in seen:
                gone[a : a + length] = [True] * length
            seen.add(w)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(u), [x for x, g in zip(u, gone) if not g], runs))
    return out


def words(t):
    return t.encode().split()


def window_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], len(r["spans"])) for r in df.collect()), key=repr)


def expected_windows(rows, length):
    return sorted(((i, n, n - len(k), b" ".join(k).decode(), runs) for i, n, k, runs in brute(rows, words, length)), key=repr)


@pytest.mark.parametrize("rows", [list(enumerate(texts(3))), ODD, []], ids=["random", "odd", "empty"])
def test_windows(spark, rows):
    got = remove_repeated_windows(documents(spark, rows))
    assert window_rows(got) == expected_windows(rows, 20)


def test_short_windows(spark):
    rows = list(enumerate(["a a a a", "b a a", "a", "c a a b"]))
    assert window_rows(remove_repeated_windows(documents(spark, rows), 2, 1)) == expected_windows(rows, 2)


def string_rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]), len(r["spans"])) for r in df.collect()), key=repr)


def expected_strings(rows, length):
    return sorted(((i, n, n - len(k), bytes(k), runs) for i, n, k, runs in brute(rows, lambda t: t.encode(), length)), key=repr)


@pytest.mark.parametrize("rows", [list(enumerate(texts(4, 40))), ODD, []], ids=["random", "odd", "empty"])
def test_strings(spark, rows):
    assert string_rows(remove_repeated_strings(documents(spark, rows))) == expected_strings(rows, 100)


def test_words_are_told_apart(spark):
    x, y = thue_morse(10)
    assert len(set(R.word_codes(f"{x} {y}".encode()).tolist())) == 2
    shared = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{x} {shared}"), (2, f"{y} {shared}"), (3, f"q {y} {shared}")]
    assert window_rows(remove_repeated_windows(documents(spark, rows))) == expected_windows(rows, 20)


def test_equal_hashes_are_confirmed():
    """Windows that a hash takes for equal are kept apart by their words."""
    units = Words(3, 1)
    numbers = units.numbers([b"a b c", b"a b d", b"a b c", b"x y z"])
    got = units.same(numbers, np.array([0, 3, 6, 9]), np.zeros(4, np.uint64))
    assert got[0] == got[2] and len(set(got.tolist())) == 3


def passages(n, rng):
    """Documents around one common passage each: frequent anchors, in different surroundings."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    common, line = " ".join(word() for _ in range(45)), " ".join(word() for _ in range(9))
    out = []
    for i in range(n):
        middle = common if i % 3 else line
        out.append(" ".join(word() for _ in range(rng.randint(0, 25))) + f" {middle} " + " ".join(word() for _ in range(rng.randint(0, 25))))
    return list(enumerate(out))


@pytest.mark.parametrize("places", [3, 10**6])
def test_frequent_anchors(spark, places):
    rows = passages(90, random.Random(places))
    limits = {"frequent_places": places, "bucket_bytes": 2000, "block": 50}
    assert window_rows(remove_repeated_windows(documents(spark, rows), **limits)) == expected_windows(rows, 20)
    assert string_rows(remove_repeated_strings(documents(spark, rows), **limits)) == expected_strings(rows, 100)


@pytest.mark.parametrize("units", [Bytes(100), Words(20)], ids=["bytes", "words"])
@pytest.mark.parametrize("together", [500, 10**6])
def test_segments(units, together, monkeypatch):
    """Texts hashed together or in segments have the anchors of each by itself, every window once."""
    data = [" ".join(t for _, t in passages(n, random.Random(n))) for n in (30, 0, 1, 2, 25)]

    def found():
        out = []
        for x in repeats.hashed(units, data):
            row = np.array([p.row for p in x.pieces])[x.owner]
            out += zip(row.tolist(), x.place(x.at, x.owner).tolist(), x.place(x.anchor, x.owner).tolist(), x.grams[x.anchor].tolist())
        return out

    want = []
    for i, t in enumerate(data):
        whole = units.split(t.encode())
        grams = R.gram_hashes(units.codes([whole]), units.gram)
        want += [(i, a, p, grams[p]) for a, p in enumerate(R.anchors(grams, units.window - units.gram + 1).tolist())]
    monkeypatch.setattr(repeats, "TOGETHER", together)
    assert found() == want
    monkeypatch.setattr(repeats, "SEGMENT", 150)
    assert found() == want


@pytest.mark.parametrize("text", ["", "a ", "the same words again and again "], ids=["letters", "words", "phrase"])
def test_very_long_text(spark, text):
    """Longer than a segment, and all of it repeats (or nothing does)."""
    n = (repeats.SEGMENT + 5000) // max(1, len(text)) if text else 0
    long = text * n if text else " ".join(f"{i:x}" for i in range(250_000))
    rows = [(1, long), (2, "x y " + long[-3000:])]
    for got, units, length in ((remove_repeated_windows(documents(spark, rows)), words, 20), (remove_repeated_strings(documents(spark, rows)), lambda t: t.encode(), 100)):
        rows_got = {r[0]: tuple(r)[1:3] for r in got.collect()}
        assert rows_got == {i: (n, n - len(k)) for i, n, k, _ in brute(rows, units, length)}


def test_one_anchor_many_contexts():
    """Sixty thousand different contexts of one anchor: all unique, in little memory."""
    rng = np.random.default_rng(0)
    anchor = bytes(rng.integers(0, 256, 32).astype(np.uint8))
    sides = rng.integers(0, 256, (60_000, 136)).astype(np.uint8)
    contexts = [repeats.Context(bytes(s[:68]) + anchor + bytes(s[68:]), i, 0, 7, 68, 69) for i, s in enumerate(sides)]
    contexts += [x._replace(rid=x.rid + 100_000, data=x.data[:150], windows=51) for x in contexts[:3]]
    units = Bytes(100)
    tracemalloc.start()
    found = []
    for part in repeats._blocks(units, [contexts], repeats.BLOCK):
        rid, start = repeats.repeated_in(units, part)
        found += zip(rid.tolist(), start.tolist())
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert sorted(found) == [(100_000 + i, a) for i in range(3) for a in range(51)]


def test_queries_on_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables_dir()}/documents.parquet").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {tuple(r)[:4] for r in op8_substring_dedup(spark, tables_dir()).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {(i, n, n - len(k), sha(b" ".join(k))) for i, n, k, _ in brute(docs, words, 20)}
    got = {tuple(r) for r in op6_suffix_array_dedup(spark, tables_dir()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {(i, n, n - len(k), runs, sha(bytes(k))) for i, n, k, runs in brute(docs, lambda t: t.encode(), 100)}


@pytest.mark.parametrize("v", [4, 7, 16, 32])
def test_cover(v):
    cover = difference_cover(v)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("seed", range(6))
def test_equal_strings(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    text[500:700] = text[100:300]
    text[750:890] = 65  # long ties at every residue
    starts = rng.permutation(900 - 72)[:600]
    got = equal_strings(text, starts, 72, 32, block=70)
    names: dict = {}
    want = [names.setdefault(text[s : s + 72].tobytes(), len(names)) for s in starts]
    assert len(set(zip(want, got.tolist()))) == len(names) == len(set(got.tolist()))


def test_rolling():
    data = "ab  c\né\x0b\x0cd a b".encode()
    codes = R.word_codes(data)
    split = data.split()
    assert len(codes) == len(split)
    assert [codes[i] == codes[j] for i in range(len(split)) for j in range(len(split))] == [a == b for a in split for b in split]
    h = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64) << np.uint64(40)
    assert R.anchors(h, 3).tolist() == [1, 1, 4, 4, 4]
    assert R.runs(np.array([1, 2, 3, 7])).tolist() == [[1, 3], [7, 1]]
