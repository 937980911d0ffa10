"""Range asymmetric numeral system with a static table, over interleaved blocks of token ids.

A block holds up to BLOCK ids, dealt over LANES states that are coded side by side; blocks are
independent, so any of them decodes by itself. All blocks of a file share one frequency table.
Many blocks are coded at once, as the rows of one array.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE = 20
LANES = 64
BLOCK = LANES * 512
LOW = np.uint64(1 << 31)
MASK32 = np.uint64(0xFFFFFFFF)
#: Blocks that are coded together: their states are one array, long enough to pay for each step.
TOGETHER = 128


class Table:
    """Frequencies that sum to 2**SCALE, at least 1 for each id that occurs."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slots = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, size = int(counts.sum()), 1 << SCALE
        used = counts > 0
        if used.sum() > size:
            raise ValueError("more ids than the table has slots")
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        freq = np.where(used, np.maximum(1, (counts.astype(np.float64) * (size / total)).astype(np.int64)), 0)
        excess = int(freq.sum()) - size
        by_size = np.argsort(-freq, kind="stable")
        if excess < 0:
            freq[by_size[0]] -= excess
        while excess > 0:  # take from the most frequent, never below 1
            room = freq[by_size] - 1
            take = np.minimum(room, np.maximum(1, (room * (excess / max(1, room.sum()))).astype(np.int64)))
            take = np.where(np.cumsum(take) <= excess, take, 0)
            if not take.any():
                take[0] = min(excess, int(room[0]))
            freq[by_size] -= take
            excess -= int(take.sum())
        return cls(freq)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def checksum(self) -> int:
        return zlib.crc32(self.freq.astype("<u8").tobytes())


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[int, bytes]]:
    """(number of ids, payload) of each block of ids."""
    out: list[tuple[int, bytes]] = []
    for lo in range(0, len(ids), BLOCK * TOGETHER):
        part = ids[lo : lo + BLOCK * TOGETHER]
        full = len(part) // BLOCK
        if full:
            out += _encode(part[: full * BLOCK].reshape(full, BLOCK), BLOCK, table)
        if len(part) > full * BLOCK:
            rest = part[full * BLOCK :]
            out += _encode(rest.reshape(1, -1), len(rest), table)
    return out


def _encode(rows: np.ndarray, count: int, table: Table) -> list[tuple[int, bytes]]:
    blocks = len(rows)
    steps = -(-count // LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words, owners = [], []
    for t in range(steps - 1, -1, -1):
        symbols = rows[:, t * LANES : (t + 1) * LANES]
        width = symbols.shape[1]
        f, c, x = table.freq[symbols], table.start[symbols], state[:, :width]
        over = x >= f << np.uint64(63 - SCALE)
        at = np.nonzero(over)
        words.append((x[at] & MASK32).astype(np.uint32))
        owners.append(at[0])
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[:, :width] = (q << np.uint64(SCALE)) + (x - q * f) + c
    words, owners = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    order = np.argsort(owners, kind="stable")
    words = words[order]
    ends = np.cumsum(np.bincount(owners, minlength=blocks))
    return [(count, state[i].astype("<u8").tobytes() + words[e - n : e].astype("<u4").tobytes()) for i, (e, n) in enumerate(zip(ends, np.bincount(owners, minlength=blocks)))]


def decode_blocks(blocks: list[tuple[int, bytes]], table: Table) -> list[np.ndarray]:
    """The ids of each (number of ids, payload); equally long blocks are decoded together."""
    out: list[np.ndarray | None] = [None] * len(blocks)
    by_count: dict[int, list[int]] = {}
    for i, (count, _) in enumerate(blocks):
        by_count.setdefault(count, []).append(i)
    for count, mine in by_count.items():
        for lo in range(0, len(mine), TOGETHER):
            some = mine[lo : lo + TOGETHER]
            for i, ids in zip(some, _decode([blocks[i][1] for i in some], count, table)):
                out[i] = ids
    return out


def _decode(payloads: list[bytes], count: int, table: Table) -> np.ndarray:
    head = 8 * LANES
    state = np.stack([np.frombuffer(p, "<u8", LANES) for p in payloads]).astype(np.uint64)
    words = np.concatenate([*[np.frombuffer(p, "<u4", offset=head) for p in payloads], np.zeros(1, np.uint32)]).astype(np.uint64)
    sizes = np.array([(len(p) - head) // 4 for p in payloads])
    cursor = np.cumsum(sizes) - sizes
    out = np.empty((len(payloads), count), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    for t in range(-(-count // LANES)):
        width = min(LANES, count - t * LANES)
        x = state[:, :width]
        slot = x & low
        symbols = table.slots[slot]
        out[:, t * LANES : t * LANES + width] = symbols
        x = table.freq[symbols] * (x >> np.uint64(SCALE)) + slot - table.start[symbols]
        under = x < LOW
        nth = np.cumsum(under, 1)
        spot = np.minimum(cursor[:, None] + nth - 1, len(words) - 1)  # damaged blocks may run over
        state[:, :width] = np.where(under, (x << np.uint64(32)) | words[np.maximum(spot, 0)], x)
        cursor = cursor + nth[:, -1]
    return out
