"""Alignment of the tokens of two tokenizers by sparse matrix products."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.blocks import stored
from stratalens.session import materialize

# Up to a blank after a character that is no white space. Every segment of a text with a blank before it begins with one.
_SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_PLAIN = re.compile(" [!-~]+")
_GROUP_CHARS = 2_000_000
_HELD_BYTES = 64 << 20
_BLOCK_BYTES, _BLOCK_ROWS = 8 << 20, 50_000
_TABLE_BYTES = 16 << 20
_ROWS = 1 << 16  # of a matrix whose products are formed at a time

_BLOCK = pa.schema([("block", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                    ("hashes", pa.list_(pa.string())), ("held", pa.list_(pa.int64())), ("pairs", pa.binary()), ("times", pa.binary())])
_FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
_N_LINKS = _FIELDS.index("n_links")
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*_FIELDS, "n_best", "count_sum")), ("groups_sha256", pa.string())])


@dataclass
class Csr:
    """A sparse matrix by rows: the columns of row i are ``columns[starts[i] : starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def spans(cls, lengths: np.ndarray) -> Csr:
        """Tokens by bytes: one row a token, ones at the bytes it covers."""
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        n = int(starts[-1])
        return cls(starts, np.arange(n), np.ones(n, np.int64), n)

    @classmethod
    def members(cls, of: np.ndarray, width: int) -> Csr:
        """One row an element, a one at its class."""
        return cls(np.arange(len(of) + 1), of, np.ones(len(of), np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, rows[order], self.values[order], len(self.starts) - 1)

    def products(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (row, column, value) of this matrix times ``other``, some rows at a time, by Gustavson's algorithm.

        Row i is the sum of the rows of ``other`` that the entries of row i point at, each times its entry; sums are
        formed over equal columns of one row.
        """
        for low in range(0, len(self.starts) - 1, _ROWS):
            starts = self.starts[low : low + _ROWS + 1]
            columns, values = self.columns[starts[0] : starts[-1]], self.values[starts[0] : starts[-1]]
            rows = np.repeat(np.arange(low, low + len(starts) - 1), np.diff(starts))
            sizes = np.diff(other.starts)[columns]
            at = np.repeat(other.starts[columns] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            keys = np.repeat(rows, sizes) * other.width + other.columns[at]
            weights = np.repeat(values, sizes) * other.values[at]
            if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys, kind="stable")
                keys, weights = keys[order], weights[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            if len(new):
                yield keys[new] // other.width, keys[new] % other.width, np.add.reduceat(weights, new)

    def entries(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = list(self.products(other))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bytes in common) of the tokens of two divisions of the same bytes, by their lengths."""
    return Csr.spans(a).entries(Csr.spans(b).transposed())


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of both divisions, and the number of groups: they end where tokens of both end."""
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    cuts = a_ends[_found(b_ends, a_ends)]
    cuts = cuts[np.diff(cuts, prepend=0) > 0]
    return np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), len(cuts)


def _found(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def shared_groups(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, 1) of the tokens that are in one group, some rows at a time, from the products of the group incidences."""
    a_of, b_of, n = groups(a, b)
    return Csr.members(a_of, n).products(Csr.members(b_of, n).transposed())


def byte_alphabet() -> dict[str, int]:
    """The byte of every character in the entries of a byte-level vocabulary: printable ones stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Tokens, groups and links of segments of text under a byte-level file and a piece model, with a bounded memory.

    The byte-level file divides a text before every blank that follows another character, and no entry of the piece
    model has a blank inside, so the tokens of a text are those of its segments, and all segment ends are cuts of both.
    Both are checked when the files are loaded; where they do not hold, whole texts are taken.
    """

    def __init__(self, a_path: str, b_path: str, limit: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        vocabulary = self._a.get_vocab(with_added_tokens=True)
        self._a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self._a_bytes[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        self._b_bytes = [bytes([int(p[3:-1], 16)]) if self._b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self._a_lengths, self._b_lengths = (np.array([len(x) for x in entries], np.int64) for entries in (self._a_bytes, self._b_bytes))
        # By 2 * id and 2 * (number of A's ids + id), the id as text before another one of its group, and as the last one.
        self._signs = [sign for last, entries in ((b"|", self._a_bytes), (b";", self._b_bytes)) for k in range(len(entries)) for sign in (b"%d," % k, b"%d%s" % (k, last))]
        self._sign_lengths = np.array([len(x) for x in self._signs], np.int64)
        with open(a_path, encoding="utf-8") as file:
            before = json.load(file).get("pre_tokenizer") or {}
        self._divides = before.get("type") == "ByteLevel" and before.get("use_regex", True) and all("▁" not in p.lstrip("▁") for p in pieces)
        self._limit = limit
        self._clear()

    def _clear(self) -> None:
        self._numbers: dict[str, int] = {}
        self._shown: list[bytes] = []
        self._stats = np.zeros((0, len(_FIELDS)), np.int64)
        self._links = np.zeros(0, np.uint64)
        self._odd = np.zeros(0, bool)
        self._sizes = np.zeros(0, np.int64)
        self._uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the segments most used since the last time, those used once not, up to half of the memory."""
        kept = np.argsort(-self._uses, kind="stable")[: self._limit // 2]
        kept = kept[(self._uses[kept] > 1) & (np.cumsum(self._sizes[kept]) <= _HELD_BYTES // 2)]
        names, shown = list(self._numbers), self._shown
        links = self._linked(kept, self._link_starts())
        stats, odd, sizes = self._stats[kept], self._odd[kept], self._sizes[kept]
        self._clear()
        self._numbers = {names[k]: number for number, k in enumerate(kept.tolist())}
        self._shown = [shown[k] for k in kept.tolist()]
        self._stats, self._links, self._odd, self._sizes, self._uses = stats, links, odd, sizes, np.zeros(len(kept), np.int64)

    def _link_starts(self) -> np.ndarray:
        return np.cumsum(self._stats[:, _N_LINKS]) - self._stats[:, _N_LINKS]

    def _linked(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The links of the segments numbered ``at``, in a row."""
        sizes = self._stats[at, _N_LINKS]
        return self._links[np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """Per text its counts (n_a, n_b, n_groups, n_links, n_shared), the hash of its groups, and its links as a << 32 | b."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= _GROUP_CHARS:
                yield from self._align(some)
                some, size = [], 0
        yield from self._align(some)

    def _align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        if len(self._shown) > self._limit or int(self._sizes.sum()) > _HELD_BYTES:
            self._forget()
        pieces = [(_SEGMENT.findall(" " + t) if self._divides else [" " + t]) if t else [] for t in texts]
        self._add(list(set().union(*pieces).difference(self._numbers)))
        counts = [len(one) for one in pieces]
        numbers = np.fromiter(map(self._numbers.__getitem__, chain.from_iterable(pieces)), np.int64, sum(counts))
        del pieces
        self._uses += np.bincount(numbers, minlength=len(self._shown))
        starts = self._link_starts()
        end = 0
        for count in counts:
            at = numbers[end : end + count]
            end += count
            if not count or self._odd[at].any():
                yield np.zeros(len(_FIELDS), np.int64), "", np.zeros(0, np.uint64)
                continue
            shown = hashlib.sha256(b";".join(map(self._shown.__getitem__, at.tolist()))).hexdigest()
            yield self._stats[at].sum(0), shown, self._linked(at, starts)

    def _add(self, segments: list[str]) -> None:
        """Remembers new segments. Several that end without a blank are encoded as one text; the others, and those of a text that fails, each."""
        plain, marked, open_ended = [], [], []
        for s in segments:
            (open_ended if not self._divides or s[-1].isspace() else plain if _PLAIN.fullmatch(s) else marked).append(s)
        given = ((plain, 5_000, True), (marked, 1_000, True), (open_ended, 5_000, False))
        parts = [self._products(group[at : at + size], as_one) for group, size, as_one in given for at in range(0, len(group), size)]
        if not parts:
            return
        number = len(self._shown)
        self._numbers.update(zip(chain(plain, marked, open_ended), range(number, number + len(segments)), strict=True))
        stats, odd, links, sizes, shown = zip(*parts, strict=True)
        self._shown.extend(chain.from_iterable(shown))
        self._stats, self._odd, self._links, self._sizes = (np.concatenate([old, *new]) for old, new in ((self._stats, stats), (self._odd, odd), (self._links, links), (self._sizes, sizes)))
        self._uses = np.concatenate([self._uses, np.zeros(len(segments), np.int64)])

    def _ids(self, segments: list[str], as_one: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The ids of both tokenizers, how many of them every segment has, and whether its tokens give its bytes; one that fails has none."""
        given = [s.encode() for s in segments]
        if as_one:
            text = "".join(segments)
            a, b = self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self._b.encode(text[1:], num_threads=1)
            ends = np.cumsum([len(x) for x in given])
            ids = [np.array(x, np.int64) for x in (a, b)]
            tokens = [np.cumsum(lengths[x]) for lengths, x in zip((self._a_lengths, self._b_lengths), ids, strict=True)]
            if _joined(self._a_bytes, a) == _joined(self._b_bytes, b) == b"".join(given) and all(_found(x, ends).all() for x in tokens):
                return ids, [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in tokens], np.ones(len(segments), bool)
        a = [x.ids for x in self._a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self._b.encode([s[1:] for s in segments], num_threads=1)
        b = [ids if s != " " else [self._b.piece_to_id("▁")] for s, ids in zip(segments, b, strict=True)]  # the model adds no blank to nothing
        good = np.array([_joined(self._a_bytes, x) == _joined(self._b_bytes, y) == s for x, y, s in zip(a, b, given, strict=True)])
        a, b = ([ids if ok else [] for ids, ok in zip(x, good, strict=True)] for x in (a, b))
        return [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)], [np.array([len(ids) for ids in x], np.int64) for x in (a, b)], good

    def _products(self, segments: list[str], as_one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Counts, failures, links, sizes and shown groups of the segments.

        They are one block-diagonal matrix of tokens by bytes for each tokenizer, whose products have the links.
        """
        (a_ids, b_ids), (a_counts, b_counts), good = self._ids(segments, as_one)
        a_lengths, b_lengths = self._a_lengths[a_ids], self._b_lengths[b_ids]
        i, j, _ = overlaps(a_lengths, b_lengths)
        links = (a_ids[i].astype(np.uint64) << np.uint64(32)) | b_ids[j].astype(np.uint64)
        a_of, b_of, n = groups(a_lengths, b_lengths)
        shared = np.concatenate([[0], np.cumsum(np.bincount(a_of, minlength=n) * np.bincount(b_of, minlength=n))])
        # Ids by group, A before B, each with the sign that follows it.
        places = np.concatenate([2 * a_of, 2 * b_of + 1])
        order = np.argsort(places, kind="stable")
        places = places[order]
        signs = 2 * np.concatenate([a_ids, b_ids + len(self._a_lengths)])[order] + (np.diff(places, append=-1) != 0)
        text = b"".join(map(self._signs.__getitem__, signs.tolist()))
        # Where every segment ends among the tokens, groups, links and signs.
        a_ends, b_ends = np.cumsum(a_counts), np.cumsum(b_counts)
        group_ends = np.concatenate([[0], a_of + 1])[a_ends]
        link_ends = np.searchsorted(i, a_ends)
        text_ends = np.concatenate([[0], np.cumsum(self._sign_lengths[signs])])[a_ends + b_ends]
        stats = np.diff(np.stack([a_ends, b_ends, group_ends, link_ends, shared[group_ends]], 1), axis=0, prepend=np.zeros((1, len(_FIELDS)), np.int64))
        starts = np.concatenate([[0], text_ends[:-1]])
        shown = [text[low : max(low, high - 1)] for low, high in zip(starts.tolist(), text_ends.tolist(), strict=True)]
        sizes = text_ends - starts + 8 * stats[:, _N_LINKS] + np.array([len(s) for s in segments], np.int64)
        return stats, ~good, links, sizes, shown


def _joined(entries: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(entries.__getitem__, ids))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker for two files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def linked_blocks(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The links of the documents in ``df`` in blocks: distinct id pairs with their documents, and which of them each document has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        found: list[tuple[np.ndarray, str, np.ndarray, np.ndarray]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            pairs = np.concatenate([x[2] for x in found])
            held = [len(x[2]) for x in found]
            distinct, local = np.unique(pairs, return_inverse=True)
            docs = np.bincount(local, minlength=len(distinct))
            # A document's pairs ascend, so their numbers are kept as steps.
            steps = np.diff(local, prepend=0)
            heads = np.cumsum([0, *held[:-1]])[np.array(held) > 0]
            steps[heads] = local[heads]
            values = [number, (distinct >> np.uint64(32)).astype(np.int32), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int32), docs, ids, np.concatenate([x[0] for x in found]),
                      [x[1] for x in found], held, _packed(steps), _packed(np.concatenate([x[3] for x in found]))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        def given() -> Iterator[tuple[int | None, str | None]]:
            for batch in batches:
                docs = batch.column(0).to_pylist()
                for at in range(0, len(docs), 200):
                    yield from zip(docs[at : at + 200], batch.column(1).slice(at, 200).to_pylist(), strict=True)

        waiting: deque[tuple[int | None, int]] = deque()

        def texts() -> Iterator[str | None]:
            for doc, text in given():
                waiting.append((doc, len(text or "")))
                yield text

        for stats, shown, pairs in align(texts()):
            doc, length = waiting.popleft()
            distinct, times = np.unique(pairs, return_counts=True)
            ids.append(doc)
            found.append((stats, shown, distinct, times))
            size += length
            if size >= _BLOCK_BYTES or len(ids) >= _BLOCK_ROWS:
                yield closed()
                ids, found, size, number = [], [], 0, number + 1
        if ids:
            yield closed()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, a array<int>, b array<int>, docs array<long>, doc_ids array<long>, counts array<long>, hashes array<string>, held array<long>, pairs binary, times binary")


def pair_counts(stage: DataFrame) -> DataFrame:
    """(a, b, docs, best): documents that hold an id pair linked, and whether no other b has more of this a."""
    pairs = stage.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("x")).select("x.*")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs")))
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256.

    A blank and the text are encoded by the byte-level file A, the text by the piece model B, which adds the blank; special
    tokens are plain text. Tokens by bytes are a sparse matrix A and B of each tokenizer; A times the transpose of B has the
    pairs of token occurrences that overlap, the links. The bytes are cut into groups where tokens of both end;
    n_shared is the number of entries of the product of the group incidences, from the sizes of its rows, since a group may be
    as large as a text. An id pair's count is the number of rows of ``df`` that hold it linked; n_best counts links whose
    pair has its A id's highest count, ties included, and count_sum adds up the counts of all links.

    Documents lie in blocks, which keep their distinct pairs and what each document has of them. Blocks send a pair once;
    its count comes back to every block that has it. The table of blocks is divided by block and is not moved.

    A null or empty text, and one whose joined tokens are not a blank and the text, has zeros and an empty hash, and adds to no
    count; repeated rows each count; an empty table gives no rows; other columns are ignored.
    """
    total = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    stage = stored(linked_blocks(df, a_path, b_path), max(1, -(-total // _TABLE_BYTES)))
    counts = materialize(pair_counts(stage))
    places = stage.select(F.col("block").alias("to"), F.posexplode(F.arrays_zip("a", "b")).alias("place", "x")).select("to", "place", "x.*")
    told = places.join(counts, ["a", "b"]).select("to", "place", "docs", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        docs, best = right.column("docs").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        row = left.to_pylist()[0]
        held = np.array(row["held"], np.int64)
        ends = np.cumsum(held)
        steps, times = _unpacked(row["pairs"]), _unpacked(row["times"])
        # Numbers ascend within a document from its first one.
        sums = np.concatenate([[0], np.cumsum(steps)])
        local = sums[1:] - np.repeat(sums[ends - held], held)
        totals = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[local], times * docs[local])] if len(local) else [np.zeros(1, np.int64)] * 2
        columns = [np.array(row["counts"], np.int64).reshape(-1, len(_FIELDS))[:, k] for k in range(len(_FIELDS))] + [x[ends] - x[ends - held] for x in totals]
        return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), *map(pa.array, columns), pa.array(row["hashes"], pa.string())], schema=_OUT)

    slim = stage.select("block", "doc_ids", "counts", "hashes", "held", "pairs", "times")
    schema = f"doc_id long, {', '.join(f'{c} long' for c in (*_FIELDS, 'n_best', 'count_sum'))}, groups_sha256 string"
    return slim.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(summed, schema)
