"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of ``length`` bytes is a suffix of the corpus cut to that length; equal ones are
neighbours in suffix order. ``repeats`` deals the suffixes that may have a partner to buckets (equal
strings share one) and hands over one block of a bucket at a time, which bounds memory. A block is
sorted by the leading ``period`` bytes, then, for the long ties that copies make, by the
precomputed ranks of cover-sample strings, then by the last ``period`` bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import keyed, table, text_bytes
from .repeats import later_windows, removed

GRAM = 32
PERIOD = 32
#: Suffixes that are sorted at a time within a block.
BLOCK = 1 << 17


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues such that every difference modulo v is one between two of them (about 2 sqrt v)."""
    s = int(np.ceil(np.sqrt(v)))
    cover = sorted({*range(s), *range(0, v, s)})
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    return tuple(cover)


@lru_cache
def shifts(v: int) -> np.ndarray:
    """[i, j]: the least d for which i + d and j + d are both in the cover of v."""
    cover = set(difference_cover(v))
    return np.array([[next(d for d in range(v) if (i + d) % v in cover and (j + d) % v in cover) for j in range(v)] for i in range(v)])


def _columns(words: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes at each position as big-endian words, the last of which may overlap."""
    offsets = [*range(0, n - 8, 8), n - 8]
    return [words[at + o] for o in offsets]


def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of the rows and the dense rank of each sorted row."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(new)


def equal_strings(text: np.ndarray, starts: np.ndarray, length: int, v: int = PERIOD, block: int = BLOCK) -> np.ndarray:
    """A group number for each start: equal if and only if the ``length`` bytes there are equal.

    ``length`` must be at least 2 v + 7. Blockwise: suffixes are split by their first two bytes
    into buckets, and buckets of about ``block`` suffixes are sorted one at a time.
    """
    if length < 2 * v + 7:
        raise ValueError("strings must be at least twice the cover's period and 7 bytes long")
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    n = len(text)
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)

    # Ranks of the cover sample, each over the bytes that any tie leaves open before its tail:
    # from within the first period up to a period before the end.
    reach = length - v + 1
    cover = np.zeros(v, bool)
    cover[list(difference_cover(v))] = True
    sample = np.flatnonzero(cover[np.arange(max(0, n - reach + 1)) % v])
    needed = np.zeros(n + 1, np.int32)
    np.add.at(needed, starts, 1)
    np.add.at(needed, np.minimum(starts + v, n), -1)
    sample = sample[np.cumsum(needed)[sample] > 0]
    ranks = np.full(n, -1, np.int32)
    if len(sample):
        order, dense = _dense(_columns(words, sample, reach))
        ranks[sample[order]] = dense

    shift = shifts(v)
    lead = words[starts] >> np.uint64(48)
    by_lead = np.argsort(lead, kind="stable")
    cuts = np.flatnonzero(np.diff(lead[by_lead])) + 1
    out = np.zeros(len(starts), np.int64)
    groups, lo = 0, 0
    for hi in [*cuts.tolist(), len(starts)]:
        if hi - lo < block and hi < len(starts):
            continue  # small suffix buckets share a block
        mine = by_lead[lo:hi]
        lo = hi
        if not len(mine):
            continue
        at = starts[mine]
        residue = at % v
        own = ranks[at + shift[residue, residue]]
        head, tail = _columns(words, at, v), _columns(words, at + length - v, v)
        order, group = _dense([*head, *tail, residue, own])
        _, tie = _dense([*[c[order] for c in head], *[c[order] for c in tail]])
        group = _across_residues(at[order], residue[order], group, tie, ranks, shift, lambda p: text[p : p + length].tobytes())
        out[mine[order]] = group + groups
        groups += int(group.max()) + 1
    return out


def _across_residues(at, residue, group, tie, ranks, shift, string, rounds: int = 16) -> np.ndarray:
    """Groups of one residue (head, tail and rank equal) joined over the residues of their tie.

    Two suffixes of different residues compare at the shift that takes both into the cover. In
    rounds, the first group left of each tie takes in all that equal it. What many different
    strings of one head and tail leave after that is named by its bytes.
    """
    rep = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # a suffix of each group
    tie, place, res = tie[rep], at[rep], residue[rep]
    names = np.arange(len(rep))
    left = names.copy()
    for _ in range(rounds):
        if not len(left):
            break
        first = np.concatenate([[True], tie[left][1:] != tie[left][:-1]])
        lead = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
        d = shift[res[left], res[lead]]
        equal = ranks[place[left] + d] == ranks[place[lead] + d]
        names[left[equal]] = lead[equal]
        left = left[~equal]
    known: dict[bytes, int] = {}
    for i in left.tolist():
        names[i] = known.setdefault(string(place[i]), i)
    return names[group]


class Bytes:
    """Windows of bytes."""

    def __init__(self, window: int, gram: int = GRAM, v: int = PERIOD) -> None:
        self.window, self.gram, self.v = window, gram, v

    def split(self, data: bytes) -> bytes:
        return data

    def join(self, units: bytes) -> bytes:
        return units

    def codes(self, pieces: list[bytes]) -> np.ndarray:
        return self.coded(self.numbers(pieces))

    def numbers(self, blobs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), np.uint8)

    def coded(self, numbers: np.ndarray) -> np.ndarray:
        return R.BYTE_CODES[numbers]

    def same(self, numbers: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return equal_strings(numbers, starts, self.window, self.v)


def _cut(length: int):
    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text, starts, counts in pdf[["doc_id", "text", "starts", "counts"]].itertuples(index=False, name=None):
                data = text.encode()
                mask = removed(len(data), starts, counts, length)
                kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if mask.any() else data
                out.append((doc_id, len(data), len(data) - len(kept), R.runs(np.flatnonzero(mask)).tolist(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"]).astype({"doc_id": "Int64"})

    return run


def remove_repeated_strings(docs: DataFrame, length: int = 100, gram: int = GRAM, v: int = PERIOD, **limits) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: one row for each row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also starts
    earlier: in a smaller doc_id, or earlier in the same document. Strings never cross documents
    and are judged on the input. ``spans`` are the maximal removed runs as [first byte, bytes];
    ``kept`` is binary, since a cut may fall within a character. ``limits``: see ``later_windows``.

    * null text: 0 bytes, one row; texts under ``length`` bytes lose nothing. Texts of any length
      are hashed in segments; the text itself is in memory whole.
    * null doc_id comes last; rows that share a doc_id are ordered by their text, equal rows in
      any one order, so all but one of them lose their strings.
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    if length < max(gram, 2 * v + 7):
        raise ValueError("length must be at least the gram, and 7 over twice the cover's period")
    rows = keyed(docs)
    later = later_windows(rows, Bytes(length, gram, v), text_bytes(docs), **limits)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary"
    return rows.join(later, "rid", "left").select("doc_id", "text", "starts", "counts").mapInPandas(_cut(length), schema)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT doc_id, i, b[i:i + 99] AS x FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM docs WHERE octet_length(b) >= 100) AS s),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM strings) AS s WHERE n > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS opens FROM again),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 99 AS hi FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) AS s GROUP BY doc_id, g),
edges AS (
  SELECT doc_id, hi + 1 AS lo, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) - 1, 1000000000000) AS hi FROM spans
  UNION ALL SELECT doc_id, 1, min(lo) - 1 FROM spans GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(hex(d.b[e.lo:least(e.hi, octet_length(d.b))]), '' ORDER BY e.lo) AS kept FROM edges e JOIN docs d ON e.doc_id = d.doc_id GROUP BY e.doc_id),
sums AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN s.doc_id IS NULL THEN d.b ELSE unhex(k.kept) END) AS kept_sha256
FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
