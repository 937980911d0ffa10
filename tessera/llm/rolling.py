"""Rolling hashes, minimizer anchors and packed exchanges for repeated-window operators.

A window is a run of L symbols (bytes or words). Two equal windows have equal k-grams, so the
smallest k-gram hash in a window (its *anchor*) is the same in both: windows whose anchor occurs
once in the corpus are proven unique and never leave their task. That filter loses nothing.

Arrays travel as packed binary columns, a few rows for each task and bucket, so that a shuffle
costs bytes and not objects. Within a task equal entries collapse before the shuffle: a key that
a third of all documents hold is one entry for each flushed chunk, whatever its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd: invertible modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one task holds at a time before it flushes packed entries.
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


#: A mixed value for each (place in the word, byte); later places are mixed when they occur.
PLACES = 16
LETTER_CODES = mix(np.arange(PLACES << 8, dtype=U64) + U64(BASE))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (BASE, INVERSE)
            )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    up, _ = POWERS.upto(max(1, len(codes)))
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def gram_hashes(codes: np.ndarray, k: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """The Rabin-Karp hash of each run of k symbols; empty if there are fewer."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    prefix = prefix_hash(codes) if prefix is None else prefix
    _, down = POWERS.upto(max(n, 1))
    return mix((prefix[k:] - prefix[:-k]) * down[:n])


def word_codes(data: bytes) -> np.ndarray:
    """A 64-bit code for each word (run without ASCII white space) of the bytes, in order.

    The sum of a mixed value for each (byte, place in the word), mixed with the length: no
    polynomial in a fixed base, so words of a special build don't share a code.
    """
    if not data:
        return np.zeros(0, U64)
    a = np.frombuffer(data, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    first = np.cumsum(length) - length  # of each word among the letters
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    letter = (place << 8) + a[~space]
    if length.max() > PLACES:
        values = LETTER_CODES[np.minimum(letter, len(LETTER_CODES) - 1)]
        late = np.flatnonzero(place >= PLACES)
        values[late] = mix(letter[late].astype(U64) + U64(BASE))
    else:
        values = LETTER_CODES[letter]
    return mix(np.add.reduceat(values, first) + length.astype(U64) * U64(BASE))


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the position of its smallest one, the first among equals."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (hashes & U64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U64)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:n], low[w - span : w - span + n])
    return (low[:n] & U64(0xFFFFFFFF)).astype(np.int64)


def runs(positions: np.ndarray) -> np.ndarray:
    """Sorted distinct positions as an (n, 2) array of start and length."""
    if not len(positions):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(positions)]]) - 1
    return np.stack([positions[first], positions[last] - positions[first] + 1], 1)


def coverage(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A mask over n symbols of those within any [start, start + length)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:n]) > 0


# Packed rows. kind 0: entries of a hash bucket. kind 1: facts that a task already knows, packed for
# a group of row ids (rid modulo the number of buckets), so that they are few rows too.
PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary"
COLUMNS = ["bucket", "kind", "a", "b", "c", "d"]
#: Facts on their way to their documents: row ids and up to two payloads.
FACTS = "grp int, a binary, b binary, c binary"


def facts(rid: np.ndarray, payload: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of kind 1: row ids and payload arrays (as uint32) for each group of row ids."""
    if not len(rid):
        return
    group = rid % buckets
    order = np.lexsort((rid, group))
    group = group[order]
    cols = [rid[order].astype(np.int64), *[p[order].astype(np.uint32) for p in payload]]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    for lo, hi in zip(cut[:-1], cut[1:]):
        blobs = [c[lo:hi].tobytes() for c in cols]
        yield (int(group[lo]), 1, *blobs, *[None] * (4 - len(blobs)))


def only_facts(rows) -> pd.DataFrame:
    """The reduce side's result: its facts as rows of FACTS."""
    return pd.DataFrame([(r[0], *r[2:5]) for r in rows], columns=["grp", "a", "b", "c"])


def to_documents(pdf: pd.DataFrame, payloads: int) -> pd.DataFrame:
    """The facts of one group of row ids as a row for each of them."""
    rid = np.frombuffer(b"".join(pdf["a"]), np.int64)
    cols = [np.frombuffer(b"".join(pdf[c]), np.uint32) for c in "bc"[:payloads]]
    order = np.argsort(rid, kind="stable")
    rid = rid[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(rid)) + 1, [len(rid)]]) if len(rid) else np.zeros(1, int)
    out = {"rid": rid[cut[:-1]]}
    for name, c in zip("ab", cols):
        c = c[order]
        out[name] = [c[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])]
    return pd.DataFrame(out)


def by_document(found: DataFrame, payloads: int = 1) -> DataFrame:
    """The facts as ``rid, a[, b]``, a row for each row id that has any."""
    schema = "rid long, " + ", ".join(f"{c} binary" for c in "ab"[:payloads])
    return found.groupBy("grp").applyInPandas(lambda p: to_documents(p, payloads), schema)


def by_bucket(h: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of kind 0: the entries of each bucket of h, sorted by h."""
    if not len(h):
        return
    bucket = (h % U64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    bucket = bucket[order]
    cols = [c[order] for c in (h, *columns)]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for lo, hi in zip(cut[:-1], cut[1:]):
        blobs = [c[lo:hi].tobytes() for c in cols]
        yield (int(bucket[lo]), 0, *blobs, *[None] * (4 - len(blobs)))


def chunks(batches: Iterator[pd.DataFrame], text: str, limit: int = CHUNK_BYTES) -> Iterator[list]:
    """Rows of the batches as tuples, in lists that hold about ``limit`` characters of text."""
    held, size = [], 0
    for pdf in batches:
        at = list(pdf.columns).index(text)
        for row in pdf.itertuples(index=False, name=None):
            held.append(row)
            size += len(row[at] or "")
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=COLUMNS)


class Sent:
    """What a task has told other tasks about keys that it holds often, so that it is told once.

    The counts of what is held back go out at the task's end. Bounded: beyond LIMIT keys, more are
    simply told again.
    """

    LIMIT = 1 << 17

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}

    def held_back(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which entries need not go: keys seen often here, whose entry went before."""
        out = np.zeros(len(h), bool)
        often = np.flatnonzero(count > 1)
        for i, x, n in zip(often.tolist(), h[often].tolist(), count[often].tolist()):
            if x in self.counts:
                self.counts[x] += n
                out[i] = True
            elif len(self.counts) < self.LIMIT:
                self.counts[x] = 0
        return out

    def rest(self, buckets: int) -> Iterator[tuple]:
        """Entries without a place (count 2 or more): what was held back."""
        left = [(x, n) for x, n in self.counts.items() if n > 1]
        h, n = np.array([x for x, _ in left], U64), np.array([n for _, n in left], np.uint32)
        return by_bucket(h, [np.full(len(h), -1, np.int64), np.zeros(len(h), np.uint32), n], buckets)


def repeated_rows(entries: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int, sent: Sent) -> pd.DataFrame:
    """Map side of a count of hashes: (hash, rid, position) of one chunk.

    A hash seen twice here is known to repeat: all its places become facts, and only one entry
    (its count above 1) goes on, for the other tasks that hold it.
    """
    h, rid, pos = entries
    order = np.argsort(h, kind="stable")
    h, rid, pos = h[order], rid[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    many = np.repeat(count > 1, count)
    rows = list(facts(rid[many], [pos[many]], buckets))
    new = ~sent.held_back(h[first], count)
    first, count = first[new], count[new]
    rows += by_bucket(h[first], [rid[first], pos[first].astype(np.uint32), count.astype(np.uint32)], buckets)
    return frame(rows)


#: The group of the rows that name frequent hashes: they are no document's facts.
FREQUENT = -1


def count_repeated(pdf: pd.DataFrame, buckets: int, frequent: int) -> pd.DataFrame:
    """Reduce side: facts pass; entries whose hash another task holds too become facts.

    Hashes with over ``frequent`` places are named in rows of the group FREQUENT.
    """
    known = pdf[pdf["kind"] == 1]
    rows = list(known.itertuples(index=False, name=None))
    part = pdf[pdf["kind"] == 0]
    if len(part):
        h, rid, pos, count = (
            np.frombuffer(b"".join(part[c]), t) for c, t in zip("abcd", (np.uint64, np.int64, np.uint32, np.uint32))
        )
        order = np.argsort(h, kind="stable")
        h, rid, pos, count = h[order], rid[order], pos[order], count[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        new = twice & (count == 1)
        rows += facts(rid[new], [pos[new]], buckets)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        total = np.add.reduceat(count.astype(np.int64), first)
        often = h[first][total > frequent]
        if len(often):
            rows.append((FREQUENT, 1, often.tobytes(), None, None, None))
    return only_facts(rows)
