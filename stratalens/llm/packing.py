"""Packing of documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratalens.llm.encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_NEVER = np.int64(1 << 40)
_TASK_BITS = 36  # windows a task may number


class SumOfSquares:
    """Windows of ``size`` tokens filled by the sum-of-squares rule.

    ``levels[h]`` counts the open windows holding h tokens. A piece goes to the level, or to a new window, that leaves
    the smallest sum of squared counts; ties go to the fullest level. Pieces as long as a window are windows of their
    own. ``close`` empties the open windows into one another, cutting pieces, so that all but one are full, and cuts
    that one into windows whose lengths are powers of two, which need no padding. It also runs when ``most_open``
    windows are open, which bounds the memory whatever the lengths are.
    """

    def __init__(self, size: int, most_open: int = 4096) -> None:
        self.size = size
        self.most_open = most_open
        self.done: list[list[tuple]] = []
        self._reset()

    def _reset(self) -> None:
        self.levels = np.zeros(self.size + 1, np.int64)
        self._leave = np.full(self.size + 1, _NEVER)  # change of the sum when a window leaves the level
        self._leave[0] = 0
        self._enter = np.ones(self.size + 1, np.int64)
        self._enter[self.size] = 0
        self._open: dict[int, list[list[tuple]]] = {}
        self._n_open = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            self.done.append([(doc, at, n, ids[4 * at : 4 * (at + self.size)])])
        if whole < n:
            self._place((doc, whole, n, ids[4 * whole :]), n - whole)
            if self._n_open > self.most_open:
                self.close()

    def _count(self, level: int, by: int) -> None:
        self.levels[level] += by
        self._n_open += by
        n = int(self.levels[level])
        self._leave[level] = 1 - 2 * n if n else _NEVER
        self._enter[level] = 2 * n + 1

    def _place(self, piece: tuple, n: int) -> None:
        change = self._leave[: self.size - n + 1] + self._enter[n:]
        level = self.size - n - int(np.argmin(change[::-1]))
        window = self._open[level].pop() if level else []
        if level:
            self._count(level, -1)
        window.append(piece)
        if level + n == self.size:
            self.done.append(window)
        else:
            self._open.setdefault(level + n, []).append(window)
            self._count(level + n, 1)

    def close(self) -> None:
        windows = [(level, w) for level in sorted(self._open, reverse=True) for w in self._open[level]]
        self._reset()
        first, last = 0, len(windows) - 1
        while first < last:
            level, window = windows[first]
            room = self.size - level
            have, donor = windows[last]
            taken = 0
            while room and donor:
                piece = donor.pop()
                length = len(piece[3]) // 4
                if length > room:
                    donor.append(_cut(piece, 0, length - room))
                    piece, length = _cut(piece, length - room, length), room
                window.append(piece)
                room -= length
                taken += length
            windows[last] = (have - taken, donor)
            windows[first] = (self.size - room, window)
            if not donor:
                last -= 1
            if not room:
                self.done.append(window)
                first += 1
        if first == last:
            self._split(*windows[first])

    def _split(self, level: int, window: list[tuple]) -> None:
        while level:
            room = 1 << (level.bit_length() - 1)
            level -= room
            part: list[tuple] = []
            while room:
                piece = window.pop(0)
                length = len(piece[3]) // 4
                if length > room:
                    window.insert(0, _cut(piece, room, length))
                    piece, length = _cut(piece, 0, room), room
                part.append(piece)
                room -= length
            self.done.append(part)


def _cut(piece: tuple, start: int, end: int) -> tuple:
    doc, at, n, ids = piece
    return doc, at + start, n, ids[4 * start : 4 * end]


def pack(df: DataFrame, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """One row per piece of a document of ``df`` (doc_id, text) with its place in a window of at most ``size`` tokens.

    Every task packs the documents of its input split in one pass; nothing is shuffled and a task keeps the pieces of
    its open windows only. ``sequence_id`` is the task's number and a counter, so a task that runs again after a lost
    executor gives the same rows. A null or empty text is the end id alone; repeated rows are packed each for itself;
    an empty table gives no rows; a null doc_id stays null. Other columns are ignored.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = SumOfSquares(size)
        number = TaskContext.get().partitionId() << _TASK_BITS

        def rows() -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for window in packer.done:
                offset = 0
                for doc, start, n, ids in window:
                    length = len(ids) // 4
                    out.append((doc, start, length, zlib.crc32(ids), n, number, offset))
                    offset += length
                number += 1
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 7, schema=_ARROW)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                packer.add(doc, ids + end)
                if len(packer.done) >= 20_000:
                    yield rows()
        packer.close()
        yield rows()

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
