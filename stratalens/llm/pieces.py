"""Pieces of many texts at a time, as bytes in numpy arrays, and a bounded memory of a value for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PAD = 16
_SHORT = 15  # bytes of a piece that two 64-bit words hold beside its length
_GROUP = 400_000  # bytes of texts taken together
_KEEP_BITS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
_WHITE, _ALNUM, _MARK, _LEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in ((b"\t\n\x0b\x0c\r ", _WHITE), (b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", _ALNUM), (b".,!?;:%$*#&", _MARK), (b"\xc2\xe1\xe2\xe3", _LEAD)):
    _CLASS[list(_chars)] |= _bit


def grouped(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some texts at a time: their UTF-8 bytes, with zeros behind them, and where each text begins, and the last ends. A null text is empty."""
    whole = texts.cast(pa.large_string()).fill_null("")
    if not len(whole):
        return
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _GROUP, "right")) - 1)
        bounds = offsets[first : last + 1] - offsets[first]
        buffer = np.zeros(int(bounds[-1]) + _PAD, np.uint8)
        buffer[: bounds[-1]] = data[offsets[first] : offsets[last]]
        yield buffer, bounds
        first = last


def _white(buffer: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which bytes are of white space as Unicode defines it."""
    white = (kinds & _WHITE).view(bool)
    leads = np.flatnonzero(kinds & _LEAD)
    if len(leads):
        a, b, c = buffer[leads], buffer[leads + 1], buffer[leads + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        for width, found in ((2, leads[two]), (3, leads[three])):
            for k in range(width):
                white[found + k] = True
    return white


def cut(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin and their sizes: a piece begins with a text, at white space behind anything else, and at a punctuation mark behind a letter or digit."""
    kinds = _CLASS[buffer]
    white = _white(buffer, kinds)
    begins = white.copy()
    begins[1:] &= ~white[:-1]
    at = np.flatnonzero(kinds & _MARK)
    at = at[at > 1]
    before = buffer[at - 1]
    letter = (kinds[at - 1] & _ALNUM > 0) | ((buffer[at - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    begins[at[letter]] = True
    begins[bounds[:-1]] = True
    starts = np.flatnonzero(begins[: bounds[-1]])
    return starts, np.diff(starts, append=bounds[-1])


def words(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words that ``str.split`` gives begin, and their sizes."""
    inside = ~(_white(buffer, _CLASS[buffer]) | ((buffer >= 0x1C) & (buffer <= 0x1F)))
    inside[bounds[-1] :] = False
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = bounds[:-1]
    begins[borders] = inside[borders]
    borders = borders[borders > 0]
    ends[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts


class Memory:
    """A 64-bit value for each piece; values are made where a piece is new, and kept for a bounded number of pieces.

    Pieces of at most 15 bytes are told apart by those bytes and their number, in two 64-bit words, and found by open
    addressing, all pieces of a group at a time; longer ones by a dictionary. When there are more than ``limit``, those
    that no later group had again are forgotten.
    """

    def __init__(self, limit: int) -> None:
        self._limit = limit
        self._clear()

    def _clear(self) -> None:
        self._n = 1  # row 0 stands for a free slot: no piece has its key
        self._low, self._high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self._values, self._met = np.zeros(1, np.uint64), np.zeros(1, bool)
        self._slots = np.zeros(1 << 12, np.int32)
        self._longs: dict[bytes, int] = {}

    def made(self, pieces: list[bytes]) -> np.ndarray:
        """The values of new pieces."""
        raise NotImplementedError

    def moved(self, values: np.ndarray) -> np.ndarray:
        """The values that go on, of the pieces kept."""
        return values

    def full(self) -> bool:
        return self._n + len(self._longs) > self._limit

    def of(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The values of the pieces at ``starts``; they hold until the next call."""
        if self.full():
            self._forget()
        eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        low = eights[starts] & _KEEP_BITS[np.minimum(sizes, 8)]
        high = (eights[starts + 8] & _KEEP_BITS[np.clip(sizes - 8, 0, 7)]) | (sizes.astype(np.uint64) << np.uint64(56))
        short = sizes <= _SHORT
        rows = self._found(low, high)
        fresh = np.flatnonzero((rows == 0) & short)
        self._met[rows] = True
        if len(fresh):
            rows[fresh] = self._added(buffer, starts, sizes, low, high, fresh)
        values = self._values[rows]
        if not short.all():
            at = np.flatnonzero(~short)
            pieces = [bytes(buffer[a : a + s]) for a, s in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
            new = [p for p in dict.fromkeys(pieces) if p not in self._longs]
            self._longs.update(zip(new, self.made(new).tolist(), strict=True))
            values[at] = [self._longs[p] for p in pieces]
        return values

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low * _MULTIPLIERS[0]) ^ (high * _MULTIPLIERS[1])
        h ^= h >> np.uint64(32)
        return ((h * _MULTIPLIERS[2]) >> np.uint64(64 - (len(self._slots).bit_length() - 1))).astype(np.int64)

    def _found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of the keys; 0 where there is none."""
        slot = self._home(low, high)
        rows = self._slots[slot]
        left = np.flatnonzero(((self._low[rows] != low) | (self._high[rows] != high)) & (rows > 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self._slots) - 1)
            there = self._slots[slot]
            rows[left] = there
            other = ((self._low[there] != low[left]) | (self._high[there] != high[left])) & (there > 0)
            left, slot = left[other], slot[other]
        return rows

    def _added(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Rows of the pieces ``fresh``, which the memory did not have."""
        order = np.lexsort((high[fresh], low[fresh]))
        ranked = fresh[order]
        first = np.concatenate([[True], (low[ranked[1:]] != low[ranked[:-1]]) | (high[ranked[1:]] != high[ranked[:-1]])])
        one = ranked[first]
        rows = np.empty(len(fresh), np.int32)
        rows[order] = self._n + np.cumsum(first) - 1
        n = self._n + len(one)
        data = buffer.data
        values = self.made([bytes(data[a : a + s]) for a, s in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)])
        if n > len(self._low):
            self._low, self._high, self._values, self._met = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self._low, self._high, self._values, self._met))
        self._low[self._n : n], self._high[self._n : n], self._values[self._n : n] = low[one], high[one], values
        self._n, before = n, self._n
        if 3 * n > len(self._slots):
            self._slots = np.zeros(1 << (4 * n).bit_length(), np.int32)
            before = 1
        self._enter(before)
        return rows

    def _enter(self, first: int) -> None:
        """Gives the rows from ``first`` on their slots."""
        rows = np.arange(first, self._n, dtype=np.int32)
        slot = self._home(self._low[first : self._n], self._high[first : self._n])
        while len(rows):
            free = self._slots[slot] == 0
            self._slots[slot[free]] = rows[free]
            left = self._slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self._slots) - 1)

    def _forget(self) -> None:
        kept = np.flatnonzero(self._met[1 : self._n])[: self._limit // 2] + 1
        low, high, values = self._low[kept], self._high[kept], self.moved(self._values[kept])
        self._clear()
        self._n = len(kept) + 1
        self._low, self._high, self._values = (np.concatenate([np.zeros(1, np.uint64), x]) for x in (low, high, values))
        self._met = np.zeros(self._n, bool)
        self._slots = np.zeros(max(1 << 12, 1 << (4 * self._n).bit_length()), np.int32)
        self._enter(1)
