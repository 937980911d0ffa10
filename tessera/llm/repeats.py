"""Windows that repeat in a corpus, found exactly: the plan that bytes and words share.

1. Windows are keyed by their anchor (see ``rolling``) and anchors are counted. A window whose
   anchor occurs once is unique and goes no further.
2. Windows of frequent anchors are counted by the hash of the whole window, so that a passage of
   many documents takes only its own windows along, not those that reach into its surroundings.
3. What is left travels as contexts: the units of a run of windows that share an anchor. Equal
   contexts collapse in each task. The contexts of a bucket are compared exactly, in blocks of
   bounded size: windows whose hash is unique in the block go first, ``same`` decides on the rest.

The number of buckets grows with the bytes of the texts, so a bucket holds about as much at any
size. Long texts are cut into overlapping segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import materialize, partitions, trimmed

#: Bytes of text for each bucket, and partitions of buckets at most: a task takes one after the other.
BUCKET_BYTES = 16 << 20
MOST_PARTITIONS = 1 << 15
#: Places that make an anchor a frequent one; grows with the corpus, which bounds their number.
FREQUENT = 4096
FREQUENT_SHARE = 1 << 27
#: Units of a text that are hashed at a time, and bytes of texts that are hashed together.
SEGMENT = 1 << 20
TOGETHER = 1 << 18
#: Windows (or quarters of bytes) that are compared at a time, units that are hashed at a time,
#: and bytes of contexts that a task remembers to have sent.
BLOCK = 1 << 18
SLAB = 1 << 17
SENT_BYTES = 8 << 20


class Context(NamedTuple):
    data: bytes
    rid: int
    start: int
    key: int  # the anchor's hash
    anchor: int  # its place in the context
    windows: int


class Units(Protocol):
    """What a window is made of."""

    window: int
    gram: int

    def split(self, data: bytes): ...  # a sliceable sequence of units

    def join(self, units) -> bytes: ...

    def codes(self, pieces: list) -> np.ndarray: ...  # of the pieces' units, end to end

    def numbers(self, blobs: list[bytes]) -> np.ndarray: ...  # equal units and no others have equal numbers

    def coded(self, numbers: np.ndarray) -> np.ndarray: ...

    def same(self, numbers: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray: ...  # group of each


class Piece(NamedTuple):
    """Units of a text from ``base`` on: all of them, or one of the overlapping parts of a long text."""

    row: int
    base: int
    units: object


def segments(units: Units, row: int, data: bytes) -> Iterator[Piece]:
    """Pieces of a text that hold every window once."""
    whole = units.split(data)
    if len(whole) <= SEGMENT + units.window:
        yield Piece(row, 0, whole)
        return
    for lo in range(0, len(whole) - units.window + 1, SEGMENT):
        yield Piece(row, lo, whole[lo : lo + SEGMENT + units.window - 1])


class Hashed:
    """Pieces hashed together, end to end; windows are those within a piece, in order.

    ``at`` is the place of each window, ``anchor`` that of its anchor and ``owner`` its piece.
    """

    def __init__(self, units: Units, pieces: list[Piece]) -> None:
        self.pieces, self.gram = pieces, units.gram
        size = np.array([len(p.units) for p in pieces])
        self.offset = np.cumsum(size) - size
        self.codes = units.codes([p.units for p in pieces])
        self.prefix = R.prefix_hash(self.codes)
        self.grams = R.gram_hashes(self.codes, units.gram, self.prefix)
        windows = np.maximum(size - units.window + 1, 0)
        self.owner = np.repeat(np.arange(len(pieces)), windows)
        self.at = np.arange(len(self.owner)) + np.repeat(self.offset - np.cumsum(windows) + windows, windows)
        self.anchor = R.anchors(self.grams, units.window - units.gram + 1)[self.at] if len(self.at) else self.at

    def place(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Places in the text, from places here."""
        return at - self.offset[owner] + np.array([p.base for p in self.pieces])[owner]

    def marked(self, packed: list) -> np.ndarray:
        """A mask of the grams here that each row's packed places in its text name."""
        out = np.zeros(len(self.codes), bool)
        for p, lo in zip(self.pieces, self.offset.tolist()):
            if packed[p.row] is not None:
                own = np.frombuffer(packed[p.row], np.uint32).astype(np.int64) - p.base
                out[own[(own >= 0) & (own <= len(p.units) - self.gram)] + lo] = True
        return out


def hashed(units: Units, texts: list[str]) -> Iterator[Hashed]:
    """All texts in batches that fit a processor's cache."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        data = text.encode()
        for piece in segments(units, row, data):
            pieces.append(piece)
            size += min(len(data), SEGMENT)
            if size >= TOGETHER:
                yield Hashed(units, pieces)
                pieces, size = [], 0
    if pieces:
        yield Hashed(units, pieces)


def window_hashes(codes: np.ndarray, length: int, at: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """The Rabin-Karp hash of the window at each place."""
    prefix = R.prefix_hash(codes) if prefix is None else prefix
    _, down = R.POWERS.upto(max(1, len(codes)))
    return R.mix((prefix[at + length] - prefix[at]) * down[at])


def _counted(found: list[tuple], buckets: int, sent: R.Sent) -> Iterator[pd.DataFrame]:
    """The rows that count the (hashes, rids, places) of a chunk."""
    if found:
        yield R.repeated_rows(tuple(map(np.concatenate, zip(*found))), buckets, sent)


def _anchor_map(units: Units, buckets: int):
    def run(batches):
        sent = R.Sent()
        for rows in R.chunks(batches, "text"):
            rids, found = np.array([r[0] for r in rows], np.int64), []
            for x in hashed(units, [r[1] for r in rows]):
                first = np.flatnonzero(np.concatenate([[True], x.anchor[1:] != x.anchor[:-1]])) if len(x.at) else x.at
                at, owner = x.anchor[first], x.owner[first]
                own = rids[np.array([p.row for p in x.pieces])[owner]]
                found.append((x.grams[at], own, x.place(at, owner)))
            yield from _counted(found, buckets, sent)
        yield R.frame(sent.rest(buckets))

    return run


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _frequent_map(units: Units, frequent: np.ndarray, buckets: int):
    """Whole-window hashes of the windows whose anchor is a frequent one."""

    def run(batches):
        sent = R.Sent()
        for rows in R.chunks(batches, "text"):
            rids, found = np.array([r[0] for r in rows], np.int64), []
            seen = [r[3] for r in rows]
            for x in hashed(units, [r[2] for r in rows]):
                often = x.marked(seen)
                places = np.flatnonzero(often)
                often[places] = _among(x.grams[places], frequent)
                chosen = np.flatnonzero(often[x.anchor])
                at, owner = x.at[chosen], x.owner[chosen]
                own = rids[np.array([p.row for p in x.pieces])[owner]]
                found.append((window_hashes(x.codes, units.window, at, x.prefix), own, x.place(at, owner)))
            yield from _counted(found, buckets, sent)
        yield R.frame(sent.rest(buckets))

    return run


def _contexts(units: Units, rows: list[tuple], frequent: np.ndarray) -> Iterator[Context]:
    """The runs of windows that share a repeated anchor; of a frequent one only repeated windows."""
    seen, again = [r[3] for r in rows], [r[4] for r in rows]
    for x in hashed(units, [r[2] for r in rows]):
        if not len(x.at):
            continue
        mine = x.marked(seen)
        keep = mine[x.anchor]
        if len(frequent):
            places = np.flatnonzero(mine)
            mine[places] = _among(x.grams[places], frequent)
            keep &= ~mine[x.anchor] | x.marked(again)[x.at]
        cut = np.flatnonzero(np.concatenate([[True], (x.anchor[1:] != x.anchor[:-1]) | (keep[1:] != keep[:-1])]))
        end = np.append(cut[1:], len(keep))
        cut, end = cut[keep[cut]], end[keep[cut]]
        owner, spots = x.owner[cut], x.anchor[cut]
        start = x.at[cut] - x.offset[owner]
        columns = (owner, start, end - cut, spots - x.at[cut], x.grams[spots])
        for o, a, n, p, h in zip(*(c.tolist() for c in columns)):
            piece = x.pieces[o]
            yield Context(units.join(piece.units[a : a + n + units.window - 1]), rows[piece.row][0], piece.base + a, h, p, n)


def collapse(contexts, first: dict[bytes, Context] | None = None) -> tuple[list[Context], list[Context]]:
    """Of equal contexts the earliest, and the others."""
    first = {} if first is None else first
    later = []
    for x in contexts:
        y = first.setdefault(x.data, x)
        if y is not x:
            if (x.rid, x.start) < (y.rid, y.start):
                first[x.data], x = x, y
            later.append(x)
    return list(first.values()), later


def _later_facts(later: list[Context], buckets: int):
    rid = np.array([x.rid for x in later], np.int64)
    return R.facts(rid, [np.array([x.start for x in later]), np.array([x.windows for x in later])], buckets)


def _context_map(units: Units, frequent: np.ndarray, buckets: int):
    def run(batches):
        sent: dict[bytes, tuple[int, int]] = {}  # contexts that met a copy here, and the earliest one sent
        room = SENT_BYTES
        for rows in R.chunks(batches, "text"):
            first, later = collapse(_contexts(units, rows, frequent))
            copied = {x.data for x in later}
            held: dict[int, list[Context]] = {}
            for x in first:
                before = sent.get(x.data)
                if before is not None and before < (x.rid, x.start):
                    later.append(x)  # the one sent before is earlier
                    continue
                if before is not None or (x.data in copied and room > 0):
                    room -= len(x.data) if before is None else 0
                    sent[x.data] = (x.rid, x.start)
                held.setdefault(x.key % buckets, []).append(x)
            out = list(_later_facts(later, buckets))
            for bucket, xs in held.items():
                numbers = np.array([(x.start, x.windows, x.anchor, len(x.data)) for x in xs], np.uint32)
                out.append((
                    bucket, 0, np.array([x.key for x in xs], np.uint64).tobytes(),
                    np.array([x.rid for x in xs], np.int64).tobytes(), numbers.tobytes(), b"".join(x.data for x in xs),
                ))
            yield R.frame(out)

    return run


def _unpack(part: pd.DataFrame) -> Iterator[Context]:
    for a, b, c, d in part[["a", "b", "c", "d"]].itertuples(index=False, name=None):
        at = 0
        numbers = np.frombuffer(c, np.uint32).reshape(-1, 4).tolist()
        for h, rid, (start, windows, anchor, size) in zip(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.int64).tolist(), numbers):
            yield Context(d[at : at + size], rid, start, h, anchor, windows)
            at += size


def _occur_twice(hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes occur more than once."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(h), bool)
    out[order] = twice
    return out


def _all_hashes(units: Units, numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hashes of all windows of contexts of the given sizes, one slab of contexts at a time."""
    ends = np.cumsum(size)
    out, lo = [], 0
    while lo < len(size):
        base = int(ends[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLAB, "right")))
        n = size[lo:hi] - units.window + 1
        at = np.arange(n.sum()) + np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi] - np.cumsum(n) + n, n)
        out.append(window_hashes(units.coded(numbers[base : int(ends[hi - 1])]), units.window, at))
        lo = hi
    return np.concatenate(out)


def repeated_in(units: Units, contexts: list[Context]) -> tuple[np.ndarray, np.ndarray]:
    """rid and start of every window of the contexts that an earlier one equals."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(contexts) < 2:
        return nothing
    numbers = units.numbers([x.data for x in contexts])
    windows = np.array([x.windows for x in contexts])
    size = windows + units.window - 1
    hashes = _all_hashes(units, numbers, size)
    twice = np.flatnonzero(_occur_twice(hashes))
    if not len(twice):
        return nothing
    ends = np.cumsum(windows)
    owner = np.searchsorted(ends, twice, "right")
    used = np.unique(owner)
    if 2 * len(used) < len(contexts):
        return repeated_in(units, [contexts[i] for i in used])
    offset = twice - (ends - windows)[owner]
    at = (np.cumsum(size) - size)[owner] + offset
    group = units.same(numbers, at, hashes[twice])
    rid = np.array([x.rid for x in contexts], np.int64)[owner]
    start = np.array([x.start for x in contexts], np.int64)[owner] + offset
    order = np.lexsort((start, rid, group))
    later = np.concatenate([[False], group[order][1:] == group[order][:-1]])
    return rid[order][later], start[order][later]


def _narrowed(units: Units, xs: list[Context], lo: int, hi: int) -> Iterator[Context]:
    """Of each context only the windows whose anchor is lo..hi-1 units behind their start."""
    for x in xs:
        a, b = max(0, x.anchor - hi + 1), min(x.windows, x.anchor - lo + 1)
        if a < b:
            piece = units.split(x.data)[a : b + units.window - 1]
            yield Context(units.join(piece), x.rid, x.start + a, x.key, x.anchor - a, b - a)


def _cost(x: Context) -> int:
    return max(x.windows, len(x.data) // 4)


def _by_content(part: list[Context], block: int) -> Iterator[list[Context]]:
    """Contexts of one window each, sorted and cut between different ones."""
    part.sort(key=lambda x: x.data)
    lo, size = 0, 0
    for i, x in enumerate(part):
        if size >= block and x.data != part[i - 1].data:
            yield part[lo:i]
            lo, size = i, 0
        size += _cost(x)
    yield part[lo:]


def _blocks(units: Units, groups: list[list[Context]], block: int) -> Iterator[list[Context]]:
    """The groups' contexts in blocks of about ``block`` windows that hold all partners of each.

    Small groups share a block. Equal windows have their anchor at the same place, so a large
    group is cut by that place; and where one place alone has too many, by the windows' content.
    """
    held, size = [], 0
    for xs in groups:
        n = sum(map(_cost, xs))
        if n <= block:
            held += xs
            size += n
            if size >= block:
                yield held
                held, size = [], 0
            continue
        units_each = max(1, sum(x.windows + units.window - 1 for x in xs) // len(xs))
        quarter = sum(len(x.data) for x in xs) / len(xs) / units_each / 4  # of a unit's bytes
        places = units.window - units.gram + 1
        step = max(1, min(places, block // len(xs), int(block / len(xs) / quarter) - units.window))
        for lo in range(0, places, step):
            part = list(_narrowed(units, xs, lo, lo + step))
            yield from _by_content(part, block) if step == 1 and part else [part]
    if held:
        yield held


def _reduce(pdf: pd.DataFrame, units: Units, buckets: int, block: int) -> pd.DataFrame:
    rows = list(pdf[pdf["kind"] == 1].itertuples(index=False, name=None))
    first, later = collapse(_unpack(pdf[pdf["kind"] == 0]))
    rows += _later_facts(later, buckets)
    by_key: dict[int, list[Context]] = {}
    for x in first:
        by_key.setdefault(x.key, []).append(x)
    # A lone context may still hold a window twice only if the anchor came twice: then it is two.
    groups = [xs for xs in by_key.values() if len(xs) > 1]
    for part in _blocks(units, groups, block):
        rid, start = repeated_in(units, part)
        rows += R.facts(rid, [start, np.ones(len(start))], buckets)
    return R.only_facts(rows)


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed rows by bucket; with more buckets than shuffle partitions, in a partition each."""
    many = buckets > partitions(packed.sparkSession)
    return packed.repartition(min(buckets, MOST_PARTITIONS), "bucket") if many else packed


def later_windows(rows: DataFrame, units: Units, text_bytes: int, bucket_bytes: int = BUCKET_BYTES, frequent_places: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """``rid, starts, counts`` (packed uint32) of the windows of ``rows(rid, doc_id, text)`` that also start earlier.

    Each start stands for ``counts`` windows from there on. The driver gets the hashes of frequent
    anchors only: those of over ``frequent_places`` places, at least one in FREQUENT_SHARE of the
    corpus, so at most a few million longs at any size.
    """
    spark = rows.sparkSession
    buckets = max(partitions(spark), -(-text_bytes // bucket_bytes))
    often = max(frequent_places, text_bytes // FREQUENT_SHARE)
    entries = _dealt(rows.select("rid", "text").mapInPandas(trimmed(_anchor_map(units, buckets)), R.PACKED), buckets)
    found = materialize(entries.groupBy("bucket").applyInPandas(lambda p: R.count_repeated(p, buckets, often), R.FACTS), "anchors")
    named = found.where(F.col("grp") == R.FREQUENT).select("a").collect()
    frequent = np.sort(np.frombuffer(b"".join(bytes(r["a"]) for r in named), np.uint64))

    # doc_id goes along unused: all joins then share one exchange of the texts.
    texts = rows.join(R.by_document(found.where(F.col("grp") != R.FREQUENT)).withColumnRenamed("a", "seen"), "rid").select("rid", "doc_id", "text", "seen")
    if len(frequent):
        entries = _dealt(texts.mapInPandas(trimmed(_frequent_map(units, frequent, buckets)), R.PACKED), buckets)
        windows = entries.groupBy("bucket").applyInPandas(lambda p: R.count_repeated(p, buckets, 1 << 62), R.FACTS)
        texts = texts.join(R.by_document(windows).withColumnRenamed("a", "again"), "rid", "left").select("rid", "doc_id", "text", "seen", "again")
    else:
        texts = texts.withColumn("again", F.lit(None).cast("binary"))
    entries = _dealt(texts.mapInPandas(trimmed(_context_map(units, frequent, buckets)), R.PACKED), buckets)
    found = entries.groupBy("bucket").applyInPandas(lambda p: _reduce(p, units, buckets, block), R.FACTS)
    return R.by_document(found, 2).withColumnsRenamed({"a": "starts", "b": "counts"})


def removed(n: int, starts, counts, window: int) -> np.ndarray:
    """A mask over n units: those that one of the windows covers."""
    if starts is None or not len(starts):
        return np.zeros(n, bool)
    at = np.frombuffer(starts, np.uint32).astype(np.int64)
    return R.coverage(n, at, np.frombuffer(counts, np.uint32).astype(np.int64) + window - 1)
