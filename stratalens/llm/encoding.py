"""Token ids of whole texts by a public tokenizer file, inside Arrow tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from stratalens.llm.pieces import Memory, cut, grouped

_GROUP_CHARS = 2_000_000
_TOGETHER = 64
_JOINED = re.compile(r" ?[^\s!<|]{1,63}")  # a piece that may stand among others: without separators and signs of special tokens
_SEPARATORS = ("\n", " ! ")
_COUNT = np.uint64(32)


class PieceEncoder(Memory):
    """Encodes texts piece by piece, with a bounded memory of pieces already seen.

    Both tokenizer families used here divide a text wherever a character is followed by white space, and wherever a
    letter or digit is followed by a punctuation mark, before they merge anything. So the ids of a text are the ids of
    its pieces in a row; the tokenizers library encodes every new piece, plain ones many in a text with a separator of
    one id between them. A piece's value is the place of its ids among those of all pieces, and their number.
    """

    def __init__(self, path: str, limit: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._separator, self._between = "", -1
        for separator in _SEPARATORS:
            parts = [self._tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", separator, " b", f"a{separator} b")]
            if not self._separator and len(parts[1]) == 1 and parts[0] + parts[1] + parts[2] == parts[3]:
                self._separator, self._between = separator, parts[1][0]
        super().__init__(limit)

    def _clear(self) -> None:
        super()._clear()
        self._ids, self._n_ids = np.zeros(1, "<u4"), 0

    def full(self) -> bool:
        return super().full() or self._n_ids > 8 * self._limit

    def __call__(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; a null text has none."""
        if isinstance(texts, pa.Array):
            for buffer, bounds in grouped(texts):
                yield from self._encode(buffer, bounds)
            return
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= _GROUP_CHARS:
                yield from self(pa.array(group, pa.large_string()))
                group, size = [], 0
        yield from self(pa.array(group, pa.large_string()))

    def _encode(self, buffer: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        starts, sizes = cut(buffer, bounds)
        values = self.of(buffer, starts, sizes)
        counts = (values & np.uint64((1 << 32) - 1)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self._ids[np.repeat((values >> _COUNT).astype(np.int64) - ends[:-1], counts) + np.arange(ends[-1])]
        at = ends[np.searchsorted(starts, bounds)].tolist()
        for first, last in zip(at[:-1], at[1:], strict=True):
            yield ids[first:last].tobytes()

    def made(self, pieces: list[bytes]) -> np.ndarray:
        """Places and numbers of the ids of new pieces, which are put behind those of the others."""
        texts = [p.decode() for p in pieces]
        together = [i for i, t in enumerate(texts) if self._separator and _JOINED.fullmatch(t)]
        parts = [together[k : k + _TOGETHER] for k in range(0, len(together), _TOGETHER)]
        found: list[int] = []
        order: list[int] = []
        counts: list[int] = []
        alone = sorted(set(range(len(texts))).difference(together))
        for part, got in zip(parts, self._tokenizer.encode_batch_fast([self._separator.join([texts[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = got.ids
            ids.append(self._between)
            if ids.count(self._between) != len(part):
                alone += part
                continue
            at = np.flatnonzero(np.array(ids) == self._between)
            order += part
            counts += np.diff(at, prepend=-1).tolist()
            found += ids
        for k in range(0, len(alone), 10_000):
            part = alone[k : k + 10_000]
            for got in self._tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False):
                ids = got.ids
                counts.append(len(ids) + 1)
                found += ids
                found.append(self._between)
            order += part
        sizes = np.array(counts, np.int64)
        first = self._n_ids + np.cumsum(sizes) - sizes
        values = np.empty(len(texts), np.uint64)
        values[order] = (first.astype(np.uint64) << _COUNT) | (sizes - 1).astype(np.uint64)
        n = self._n_ids + len(found)
        if n > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(n, "<u4")])
        self._ids[self._n_ids : n] = np.array(found, np.int64)
        self._n_ids = n
        return values

    def moved(self, values: np.ndarray) -> np.ndarray:
        counts = (values & np.uint64((1 << 32) - 1)).astype(np.int64)
        ends = np.cumsum(counts)
        self._held = self._ids[np.repeat((values >> _COUNT).astype(np.int64) - (ends - counts), counts) + np.arange(int(counts.sum()))]
        return ((ends - counts).astype(np.uint64) << _COUNT) | counts.astype(np.uint64)

    def _forget(self) -> None:
        super()._forget()
        self._ids, self._n_ids = self._held, len(self._held)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
