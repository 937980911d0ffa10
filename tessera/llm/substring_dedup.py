"""Substring removal by Rabin-Karp hashes of every fixed-length token window.

Every window of ``window`` words is hashed and the hashes are counted in Spark, in the two steps
of ``repeats``: by the anchor, then whole. Windows of equal hash are confirmed by their words; each
occurrence but the earliest marks its words, and marked windows merge into maximal removal
intervals.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import keyed, text_bytes
from .repeats import later_windows, removed

GRAM = 8


class Words:
    """Windows of words."""

    def __init__(self, window: int, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram

    def split(self, data: bytes) -> list[bytes]:
        return data.split()

    def join(self, units: list[bytes]) -> bytes:
        return b" ".join(units)

    def codes(self, pieces: list[list[bytes]]) -> np.ndarray:
        return R.word_codes(b" ".join([b" ".join(p) for p in pieces]))

    def numbers(self, blobs: list[bytes]) -> np.ndarray:
        """Distinct words are numbered as they come, so different words never share a number."""
        known: dict[bytes, int] = {}
        words = b" ".join(blobs).split(b" ")
        return np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))

    def coded(self, numbers: np.ndarray) -> np.ndarray:
        return R.mix(numbers + R.U64(1))

    def same(self, numbers: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Windows in order of their hashes; neighbours are equal if all of their words are."""
        order = np.argsort(hashes, kind="stable")
        at, h = starts[order], hashes[order]
        equal = h[1:] == h[:-1]
        for i in range(self.window):
            equal &= numbers[at[1:] + i] == numbers[at[:-1] + i]
        group = np.cumsum(np.concatenate([[True], ~equal]))
        if (~equal & (h[1:] == h[:-1])).any():  # one hash, different words: name windows by their words
            names: dict[bytes, int] = {}
            group = np.array([names.setdefault(numbers[a : a + self.window].tobytes(), len(names)) for a in at])
        out = np.empty(len(order), np.int64)
        out[order] = group
        return out


def _cut(window: int):
    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text, starts, counts in pdf[["doc_id", "text", "starts", "counts"]].itertuples(index=False, name=None):
                words = text.encode().split()
                mask = removed(len(words), starts, counts, window)
                kept = list(compress(words, ~mask)) if mask.any() else words
                spans = R.runs(np.flatnonzero(mask)).tolist()
                out.append((doc_id, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"]).astype({"doc_id": "Int64"})

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 20, gram: int = GRAM, **limits) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_text``: one row for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it has the words of a window that
    starts earlier: in a smaller doc_id, or earlier in the same document (overlaps count).
    ``spans`` are the maximal removed runs as [first word, words]. ``limits``: see ``later_windows``.

    * null text: no words, one row; fewer words than the window: nothing goes. Texts of any length
      are hashed in segments; the text itself is in memory whole.
    * null doc_id comes last; rows that share a doc_id are ordered by their text, equal rows in
      any one order, so all but one of them lose their windows.
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    rows = keyed(docs)
    later = later_windows(rows, Words(window, gram), text_bytes(docs), **limits)
    schema = "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept_text string"
    return rows.join(later, "rid", "left").select("doc_id", "text", "starts", "counts").mapInPandas(_cut(window), schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, hash(list_slice(w, i, i + 19)) AS h, list_slice(w, i, i + 19) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20) AS s),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, x ORDER BY doc_id, i) AS n FROM windows) AS s WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
placed AS (SELECT w.doc_id, w.i, w.word, max(a.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN again a ON w.doc_id = a.doc_id AND w.i = a.i),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM placed)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256, coalesce(k.n_spans, 0)::BIGINT AS n_spans
FROM docs d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE starts) AS n_spans
  FROM runs GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""
