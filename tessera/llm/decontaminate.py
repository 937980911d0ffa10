"""Benchmark decontamination: every training passage queries an index of the test items.

The items are the indexed side, since they are few: a BM25 inverted index with impacts divided by
the item's score against itself, so that 1 means "all of the item". Term weights come from all
items. Passages overlap by half and are at least twice as long as an item, by classes of item
length, so a leaked item lies whole within one; an item's score depends on no other index.
Indexes of bounded size are files in the shared folder, and a task holds one at a time. A passage first
meets the bounds of item blocks (its terms' largest impacts in the block, all blocks and passages
of a document at once), and where a block's bound reaches the threshold, block-max WAND runs over
the postings. A document that holds the question without the answer scores too little for that, so
the questions' n-grams are looked up in the whole document besides. What either way retrieves is
verified exactly: the overlap of the item's question and answer n-grams with the document.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table, trimmed
from .files import open_file, write_file
from .rolling import mix

K1, B = 1.2, 0.75
RETRIEVE = 0.6  # of the item's score against itself; binds only questions of under GRAM words
OVERLAP = 0.8
GRAM = 5
PASSAGE = 128
#: Items a block of the index holds, and blocks at most (they grow with the index instead).
BLOCK_ITEMS, MAX_BLOCKS = 4, 64
#: Characters of items in one index: what a task holds is bounded, more items make more indexes.
SHARD_CHARS = 8 << 20
#: Numbers that one step of the bounds takes, and characters of documents that meet one index after
#: the other.
STEP = 1 << 18
HELD_CHARS = 32 << 20

_word = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and that sentence; without two, all is question."""
    parts = [w for w in (words_of(s) for s in re.split(r"(?<=[.?!])\s+|\n+", text or "")) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def gram_codes(numbers: np.ndarray, none: int = -1) -> np.ndarray:
    """64-bit hashes of the distinct runs of GRAM numbers, but for those with ``none`` in them."""
    if len(numbers) < GRAM:
        return np.zeros(0, np.uint64)
    known = np.convolve(numbers != none, np.ones(GRAM, np.int64), "valid")
    at = np.flatnonzero(known == GRAM)
    codes = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        codes = mix(codes ^ numbers[at + i].astype(np.uint64)) + np.uint64(i)
    return np.unique(codes)


@dataclass
class Posting:
    items: list[int]  # rising item numbers
    impacts: list[float]
    top: float  # the largest impact
    tops: list[float]  # the largest impact in each item block


@dataclass
class Corpus:
    """What term weights take from all items: their number, mean length and document frequencies."""

    items: int
    mean: float
    df: dict[str, int]


def passage_size(words: int) -> int:
    """The words of a passage for items of a length: at least twice as many, a power of two."""
    size = PASSAGE
    while size < 2 * words:
        size *= 2
    return size


class Index:
    """BM25 postings over ``items`` (id, text); items are numbered by their length in words."""

    def __init__(self, items: list[tuple], corpus: Corpus | None = None, size: int | None = None) -> None:
        kept = sorted(((len(w), str(i), i, t, w) for i, t in items if (w := words_of(t))), key=lambda x: x[:2])
        self.ids = [x[2] for x in kept]
        self.parts = [question_and_answer(x[3]) for x in kept]
        self.grams = [(grams(q), grams(a)) for q, a in self.parts]
        lengths = np.array([x[0] for x in kept], float)
        self.size = size or passage_size(int(lengths.max()) if len(kept) else 0)
        self.block_items = max(BLOCK_ITEMS, -(-len(kept) // MAX_BLOCKS))
        self.blocks = -(-len(kept) // self.block_items)
        found: dict[str, dict[int, int]] = {}
        for n, x in enumerate(kept):
            for w in x[4]:
                at = found.setdefault(w, {})
                at[n] = at.get(n, 0) + 1
        if corpus is None:  # these items are all there are
            corpus = Corpus(len(kept), float(lengths.mean()) if len(kept) else 1.0, {w: len(at) for w, at in found.items()})
        self.terms = {w: i for i, w in enumerate(found)}
        own = np.zeros(len(kept))
        raw = []
        for w, at in found.items():
            nos = np.fromiter(at, np.int64, len(at))
            tf = np.fromiter(at.values(), float, len(at))
            idf = np.log(1 + (corpus.items - corpus.df[w] + 0.5) / (corpus.df[w] + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[nos] / corpus.mean))
            own[nos] += impact
            raw.append((nos, impact))
        self.postings = []
        self.bounds = np.zeros((len(raw) + 1, max(1, self.blocks)), np.float32)  # the last row: no term
        for i, (nos, impact) in enumerate(raw):
            share = impact / own[nos]
            tops = np.zeros(max(1, self.blocks))
            np.maximum.at(tops, nos // self.block_items, share)
            self.postings.append(Posting(nos.tolist(), share.tolist(), float(share.max()), tops.tolist()))
            self.bounds[i] = tops
        codes = [gram_codes(self.numbers(q)) for q, _ in self.parts]
        self.gram_counts = np.array([len(c) for c in codes], np.int64)
        every, owner = np.concatenate([*codes, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(kept)), self.gram_counts)
        order = np.argsort(every, kind="stable")
        self.gram_codes, self.gram_items = every[order], owner[order]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' term numbers; words of no item have the number after the last."""
        none = len(self.terms)
        return np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))

    def passages(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Term numbers of overlapping passages, a row each, every term once; the rest is no term.

        A few rows at a time, so that a long text or a long passage takes bounded memory.
        """
        none, size = len(self.terms), self.size
        step = size // 2
        count = max(1, -(-(len(ids) - size) // step) + 1) if len(ids) > size else 1
        together = max(1, STEP // size)
        for lo in range(0, count, together):
            n = min(together, count - lo)
            padded = np.full((n - 1) * step + size, none)
            part = ids[lo * step : lo * step + len(padded)]
            padded[: len(part)] = part
            rows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, size)[::step], axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
            yield rows

    def hopeful(self, rows: np.ndarray, threshold: float) -> np.ndarray:
        """Which passages have a block whose bound reaches the threshold (block maxima, summed)."""
        out = np.zeros(len(rows), bool)
        wide = max(1, STEP // self.bounds.shape[1])  # terms in one step
        together = max(1, wide // rows.shape[1])
        for lo in range(0, len(rows), together):
            part = rows[lo : lo + together]
            total = self.bounds[part[:, :wide]].sum(1)
            for at in range(wide, part.shape[1], wide):
                total += self.bounds[part[:, at : at + wide]].sum(1)
            out[lo : lo + len(part)] = (total >= threshold - 1e-4).any(1)
        return out

    def wand(self, terms: list[int], threshold: float) -> dict[int, float]:
        """Every item whose score for the terms reaches the threshold, by block-max WAND."""
        found: dict[int, float] = {}
        slack = threshold - 1e-9
        cursors = [[p.items[0], 0, p] for p in (self.postings[t] for t in terms)]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[2].top
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block_items
            if sum(c[2].tops[block] for c in cursors[: pivot + 1]) < slack:
                # Nothing in this block for these lists: go on behind it, or at the next list.
                target = (block + 1) * self.block_items
                if pivot + 1 < len(cursors):
                    target = min(target, max(cursors[pivot + 1][0], item + 1))
            elif cursors[0][0] == item:
                score = sum(c[2].impacts[c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    found[item] = score
                target = item + 1
            else:
                target = item
            alive = []
            for i, c in enumerate(cursors):
                if i <= pivot and c[0] < target:
                    c[1] = bisect_left(c[2].items, target, c[1])
                    if c[1] >= len(c[2].items):
                        continue
                    c[0] = c[2].items[c[1]]
                alive.append(c)
            cursors = alive
        return found

    def asked(self, ids: np.ndarray, overlap: float) -> list[int]:
        """Items whose question has ``overlap`` of its n-grams anywhere in the text, GRAM words or more."""
        codes = gram_codes(ids, len(self.terms))
        if not len(codes):
            return []
        lo = np.searchsorted(self.gram_codes, codes)
        hits = self.gram_codes[np.minimum(lo, len(self.gram_codes) - 1)] == codes if len(self.gram_codes) else np.zeros(len(codes), bool)
        if not hits.any():
            return []
        hi = np.searchsorted(self.gram_codes, codes[hits], "right")
        found = np.bincount(np.concatenate([self.gram_items[a:b] for a, b in zip(lo[hits], hi)]), minlength=len(self.ids))
        return np.flatnonzero((found > 0) & (found >= overlap * self.gram_counts - 1e-9)).tolist()

    def score(self, n: int, ids: np.ndarray) -> float:
        """An item's score for the best of the passages."""
        weights = np.zeros(len(self.terms) + 1)
        for t in {self.terms[w] for part in self.parts[n] for w in part}:
            p = self.postings[t]
            weights[t] = p.impacts[bisect_left(p.items, n)]
        return max(float(weights[rows].sum(1).max()) for rows in self.passages(ids))

    def matches(self, text: str | None, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> list[tuple]:
        """(item id, score, question overlap, answer overlap) of each item that the text leaks."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        ids = self.numbers(words)
        best: dict[int, float] = {}
        none = len(self.terms)
        for rows in self.passages(ids):
            for r in np.flatnonzero(self.hopeful(rows, retrieve)):
                terms = rows[r]
                for n, score in self.wand(terms[terms != none].tolist(), retrieve).items():
                    best[n] = max(score, best.get(n, 0.0))
        for n in self.asked(ids, overlap):
            if n not in best:
                best[n] = self.score(n, ids)
        out = []
        have: dict[int, set] = {}
        for n in sorted(best):
            shares = []
            for own in self.grams[n]:
                size = len(next(iter(own))) if own else 0
                if size and size not in have:
                    have[size] = grams(words, size) if len(words) >= size else set()
                shares.append(len(own & have[size]) / len(own) if own else 1.0)
            if shares[0] >= overlap:
                out.append((self.ids[n], best[n], *shares))
        return out


def _sized(batches):
    for pdf in batches:
        yield pd.DataFrame({"item_id": pdf["item_id"].astype("Int64"), "text": pdf["text"], "n": [len(words_of(t)) for t in pdf["text"]]})


def _terms(batches):
    for pdf in batches:
        rows = [(size, shard, w) for size, shard, t in pdf[["size", "shard", "text"]].itertuples(index=False, name=None) for w in set(words_of(t))]
        yield pd.DataFrame(rows, columns=["size", "shard", "term"])


def write_indexes(benchmark: DataFrame, folder: str, shard_chars: int = SHARD_CHARS) -> list[str]:
    """The files of the items' indexes: for each class of item length, one for each ``shard_chars``.

    Weights are those of all items, whatever the number of indexes. Tasks build and write them; the
    driver gets the sums of the length classes and a path for each index.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.mapInPandas(_sized, "item_id long, text string, n long").where("n > 0")
    size = F.greatest(F.lit(PASSAGE).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") * 2.0) - 1e-9)).cast("long"))
    items = materialize(items.withColumn("size", size), "items")
    classes = items.groupBy("size").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).collect()
    if not classes:
        return []
    count, mean = sum(c["n"] for c in classes), sum(c["words"] for c in classes) / sum(c["n"] for c in classes)
    shards = F.lit(1)
    for c in classes:
        shards = F.when(F.col("size") == c["size"], F.lit(c["chars"] // shard_chars + 1)).otherwise(shards)
    items = items.withColumn("shard", F.pmod(F.xxhash64("text"), shards).cast("long"))
    terms = materialize(items.mapInPandas(_terms, "size long, shard long, term string"), "item-terms")
    df = terms.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    weights = terms.distinct().join(df, F.col("term") == F.col("t")).select("size", "shard", "term", "df")

    def build(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"path": []}, dtype=str)
        corpus = Corpus(count, mean, dict(zip(known["term"], known["df"].tolist())))
        rows = [(None if pd.isna(i) else int(i), t) for i, t in mine[["item_id", "text"]].itertuples(index=False, name=None)]
        index = Index(rows, corpus, int(mine["size"].iloc[0]))
        path = f"{folder}/{uuid.uuid4().hex}.index"  # another attempt of this task writes another file
        write_file(path, [zlib.compress(pickle.dumps(index), 1)])
        return pd.DataFrame({"path": [path]})

    built = items.groupBy("size", "shard").cogroup(weights.groupBy("size", "shard")).applyInPandas(build, "path string")
    return sorted(r["path"] for r in built.collect())


@lru_cache(1)
def load_index(path: str) -> Index:
    with open_file(path) as f:
        return pickle.loads(zlib.decompress(f.read()))


def held(batches, size, limit: int) -> Iterator[list]:
    """Batches in lists of about ``limit`` characters, so that loading one index after the other pays."""
    part, chars = [], 0
    for batch in batches:
        part.append(batch)
        chars += size(batch)
        if chars >= limit:
            yield part
            part, chars = [], 0
    if part:
        yield part


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, leak``: a row for each leaked item.

    An item is leaked by a document if ``overlap`` of the question's word 5-grams are in the
    document: ``leak`` is ``item`` where as much of the answer's is there too (or there is none),
    else ``question``. A question of under 5 words says little by itself: the
    whole of it must be there, and a passage that scores ``retrieve`` of what the item scores
    against itself. ``score`` is the best passage's; the answer's share is reported (1 without an
    answer). No shuffle of documents: tasks hold one bounded index at a time and read them once.

    * null or empty texts, on either side, match nothing; a null doc_id or item_id is kept;
      repeated documents give their rows each, repeated items too. Empty tables: no rows. Other
      columns are ignored. Texts and items of any length are met in bounded steps.
    """
    paths = write_indexes(benchmark, scratch_path(docs.sparkSession, "indexes"), shard_chars)
    names, limit = [c.split()[0] for c in LEAKS.split(", ")], HELD_CHARS if len(paths) > 1 else 0

    def run(batches):
        for part in held(batches, lambda pdf: pdf["text"].str.len().sum(), limit):
            for path in paths:
                index = load_index(path)
                rows = [(d, *m) for pdf in part for d, t in pdf[["doc_id", "text"]].itertuples(index=False, name=None) for m in index.matches(t, retrieve, overlap)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

    leak = F.when(F.col("answer_overlap") >= overlap, "item").otherwise("question")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(trimmed(run), LEAKS).withColumn("leak", leak)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they are; see ``find_leaks``.

    Null and empty texts leak nothing and stay, with whatever other columns; repeated rows go or
    stay together; without items all stay; an empty table stays empty.
    """
    paths = write_indexes(benchmark, scratch_path(docs.sparkSession, "indexes"), shard_chars)
    limit = HELD_CHARS if len(paths) > 1 else 0

    def run(batches):
        def texts(batch):
            return batch.column(batch.schema.get_field_index("text"))

        for part in held(batches, lambda batch: texts(batch).nbytes, limit):
            clean = [np.ones(batch.num_rows, bool) for batch in part]
            for path in paths:
                index = load_index(path)
                for batch, fine in zip(part, clean):
                    for i in np.flatnonzero(fine):
                        fine[i] = not index.matches(texts(batch)[int(i)].as_py(), retrieve, overlap)
            for batch, fine in zip(part, clean):
                yield batch.filter(pa.array(fine))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("score", F.round("score", 6))
