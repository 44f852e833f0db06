"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.blocks import stored
from stratalens.llm.hashing import mixed
from stratalens.session import materialize

# A difference cover: every difference modulo the period is one of two members.
_PERIOD, _COVER = 21, (3, 6, 7, 12, 14)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20
_BLOCK_BYTES, _BLOCK_ROWS = 6 << 20, 20_000
_BUCKET_BYTES = 16 << 20  # text whose suffixes are sorted at a time
_NO_ID = (1 << 63) - 1

_BLOCK = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("lengths", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())),
                    ("row_doc", pa.list_(pa.int64())), ("row_text", pa.list_(pa.int64()))])
_LIST = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("ordinals", pa.binary()), ("docs", pa.binary())])
_NOTE = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
_NOTE_DDL = "block long, kind long, bucket long, bits binary"
_LIST_DDL = "block long, bucket long, n long, hashes binary, ordinals binary, docs binary"
_DEAD, _REPEATED, _EARLIER = 0, 1, 2  # kinds of notes to a block


class StringHashes:
    """64-bit hashes of the strings of any lengths up to ``longest`` in a piece of a buffer."""

    def __init__(self, data: np.ndarray, longest: int) -> None:
        level = _TABLE[data]
        self._levels = [level]
        for k in range(longest.bit_length() - 1):
            step = 1 << k
            level = level[: max(0, len(level) - step)] * _power(step) + level[step:]
            self._levels.append(level)

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        at = 0
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                out *= _power(1 << k)
                out += self._levels[k][places + at]
                at += 1 << k
        return mixed(out)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def packed(values: np.ndarray) -> bytes:
    """Ascending values as compressed differences, their bytes grouped by significance."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class Block:
    """Distinct texts one after another, in the order of their smallest doc_id."""

    def __init__(self, row: dict, notes: pa.Table, length: int) -> None:
        self.id, self.length = row["block"], length
        self.lengths, self.docs = np.array(row["lengths"], np.int64), np.array(row["docs"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"]), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.live = np.ones(len(self.docs), bool)
        self.notes: dict[tuple[int, int], bytes] = {}
        for kind, bucket, bits in zip(*(notes.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True):
            if kind == _DEAD:
                self.live[bucket] = False
            else:
                self.notes[kind, bucket] = bits

    def _rooms(self, length: int) -> np.ndarray:
        """Whether a string of ``length`` bytes from each place lies in one text that is the first of its copies."""
        out = np.zeros(len(self.data), bool)
        for start, end, live in zip(self.ends - self.lengths, self.ends, self.live, strict=True):
            if live:
                out[start : max(start, end - length + 1)] = True
        return out

    def _hashed(self, places: np.ndarray, length: int) -> np.ndarray:
        parts = [np.zeros(0, np.uint64)]
        for at in range(0, len(self.data), _SLICE):
            low, high = np.searchsorted(places, [at, at + _SLICE])
            if high > low:
                parts.append(StringHashes(self.data[at : at + _SLICE + length], length).at(places[low:high] - at, length))
        return np.concatenate(parts)

    def names(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover sample, and the names of the strings there that any two equal strings have in common."""
        short = self.length - _PERIOD + 1
        covered = np.zeros(_PERIOD, bool)
        covered[list(_COVER)] = True
        places = np.flatnonzero(self._rooms(short) & np.resize(covered, len(self.data)))
        return places, self._hashed(places, short) >> np.uint64(64 - bits)

    def suffixes(self, bits: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose next period has a name that is repeated somewhere, and the hashes of the strings there."""
        places, names = self.names(bits)
        distinct, back, counts = np.unique(names, return_inverse=True, return_counts=True)
        again = (counts > 1) | self.noted(_REPEATED, distinct >> np.uint64(bits - bucket_bits))
        before = np.zeros(len(self.data) + 1, np.int32)
        before[1:][places[again[back]]] = 1
        np.cumsum(before, out=before)
        ahead = before[np.minimum(np.arange(_PERIOD, _PERIOD + len(self.data)), len(self.data))] > before[:-1]
        found = np.flatnonzero(ahead & self._rooms(self.length))
        return found, self._hashed(found, self.length)

    def noted(self, kind: int, buckets: np.ndarray) -> np.ndarray:
        """The bits that came back for ascending entries of the given ``buckets``."""
        out = np.zeros(len(buckets), bool)
        which, starts, counts = np.unique(buckets, return_index=True, return_counts=True)
        for bucket, start, n in zip(which.tolist(), starts.tolist(), counts.tolist(), strict=True):
            bits = self.notes.get((kind, bucket))
            if bits is not None:
                out[start : start + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return out

    def firsts(self, found: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, the first text of each, and where every place's hash is among them."""
        owner = np.searchsorted(self.ends, found, "right").astype(np.uint32)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        return distinct, owner[at], back  # places ascend, so the first one is in the first text


def _lists(block: Block, hashes: np.ndarray, buckets: np.ndarray, ordinals: np.ndarray | None) -> Iterator[dict]:
    which, starts, counts = np.unique(buckets, return_index=True, return_counts=True)
    docs = None if ordinals is None else packed(block.docs)
    for bucket, start, n in zip(which.tolist(), starts.tolist(), counts.tolist(), strict=True):
        some = None
        if ordinals is not None:
            some = zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(ordinals[start : start + n].view(np.uint8).reshape(-1, 4).T).tobytes())
        yield {"block": block.id, "bucket": bucket, "n": n, "hashes": packed(hashes[start : start + n]), "ordinals": some, "docs": docs}


def blocks(df: DataFrame, rows: int = _BLOCK_ROWS, size: int = _BLOCK_BYTES) -> DataFrame:
    """The texts of ``df`` (doc_id, text) in compressed blocks of about ``size`` bytes, equal texts of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[bytes, list] = {}
        n = total = 0

        def closed() -> pa.RecordBatch:
            texts = sorted(held.items(), key=lambda x: min(x[1]))
            keys = [xxhash.xxh3_128_intdigest(t) for t, _ in texts]
            signed = [np.array([k >> s & 2**64 - 1 for k in keys], np.uint64).view(np.int64) for s in (0, 64)]
            row_doc, row_text = [d for _, ids in texts for d in ids], [k for k, (_, ids) in enumerate(texts) for _ in ids]
            values = [number, zstandard.ZstdCompressor(3).compress(b"".join(t for t, _ in texts)), [len(t) for t, _ in texts], [min(ids) for _, ids in texts], *signed, row_doc, row_text]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = held.setdefault(text, [])
                # A copy under a larger id is removed whole; any other row comes back with its text.
                total += len(text) if not ids or doc <= min(ids) else 0
                ids.append(doc)
                n += 1
                if total >= size or n >= rows:
                    yield closed()
                    held, n, total, number = {}, 0, 0, number + 1
        if held:
            yield closed()

    given = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(run, "block long, payload binary, lengths array<long>, docs array<long>, k1 array<long>, k2 array<long>, row_doc array<long>, row_text array<long>")


def repeats(df: DataFrame, length: int = 50) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_bytes, spans of bytes to remove, and the kept bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id; strings
    are judged on the input and never cross documents. Texts lie in blocks of some megabytes, and the suffixes of the corpus are
    sorted one bucket at a time, by their first ``length`` bytes:

    1. Of equal texts, only the one with the smallest doc_id goes on; the others lose every byte.
    2. The cover sample is ranked: at places whose number modulo 21 is in the difference cover, the next ``length`` - 20
       bytes get a name. However two equal strings lie, one of the first 21 places of both is in the sample at the same
       distance, so their names there are equal. Each block sends its distinct names by bucket; one bucket of names is
       sorted at a time, and the names of several blocks come back as bits.
    3. A suffix none of whose next 21 places has a repeated rank has no equal anywhere and needs no sorting. The others,
       64 bits each, go to their buckets with their first document. One bucket is sorted at a time; bits come back
       for those that an earlier document has too.

    What a task holds is a block or a bucket, whatever repeats how often: a string counts once a block. Texts are moved
    once, into a table divided by block. Strings are told apart by 64-bit hashes. ``length`` is 30 at least.

    A null text is empty and has no spans; texts of fewer than ``length`` bytes stay; a null doc_id counts as larger than
    all others; rows of one doc_id never remove one another, so repeated rows are judged alike; an empty table gives no
    rows; other columns are ignored.
    """
    if length < 30:
        raise ValueError("strings of fewer than 30 bytes are too short for the cover")
    total = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    pieces = max(1, -(-total // _BUCKET_BYTES))
    bucket_bits = max(1, (pieces - 1).bit_length())
    # So many bits that one name in some hundreds is taken for another one, which costs a needless suffix.
    bits = max(24, bucket_bits + 8, int(total * len(_COVER) // _PERIOD).bit_length() + 8)

    stage = stored(blocks(df), pieces)
    texts = stage.select("block", F.posexplode(F.arrays_zip("k1", "k2", "docs", "lengths")).alias("text", "x")).select("block", "text", "x.*")
    firsts = texts.groupBy("k1", "k2", "lengths").agg(F.min("docs").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    dead = materialize(texts.join(firsts, ["k1", "k2", "lengths"]).where("docs > first").select("block", F.lit(_DEAD).cast("long").alias("kind"), F.col("text").cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits")))
    slim = stage.select("block", "payload", "lengths", "docs")

    def ranked(left: pa.Table, notes: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row, notes, length)
            names = np.unique(block.names(bits)[1])
            out += _lists(block, names, names >> np.uint64(bits - bucket_bits), None)
        return pa.Table.from_pylist(out, schema=_LIST)

    def shared(table: pa.Table) -> pa.Table:
        """Which names of one bucket several blocks have."""
        return _answers(table, _REPEATED, lambda first, counts, docs: counts > 1)

    def sent(left: pa.Table, notes: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row, notes, length)
            distinct, ordinals, _ = block.firsts(*block.suffixes(bits, bucket_bits))
            out += _lists(block, distinct, distinct >> np.uint64(64 - bucket_bits), ordinals)
        return pa.Table.from_pylist(out, schema=_LIST)

    def earlier(table: pa.Table) -> pa.Table:
        """Which suffixes of one bucket an earlier document has."""
        return _answers(table, _EARLIER, lambda first, counts, docs: first < docs)

    def removed(left: pa.Table, notes: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row, notes, length)
            found, hashes = block.suffixes(bits, bucket_bits)
            distinct, first, back = block.firsts(found, hashes)
            before = block.noted(_EARLIER, distinct >> np.uint64(64 - bucket_bits))
            owner = np.searchsorted(block.ends, found, "right")
            again = found[before[back] | (block.docs[owner] > block.docs[first][back])]
            out += _kept(block, row, again)
        return pa.Table.from_pylist(out, schema=_OUT)

    def met(notes: DataFrame, blocks: DataFrame, step, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(step, schema)

    notes = dead.unionByName(materialize(met(dead, slim, ranked, _LIST_DDL).groupBy("bucket").applyInArrow(shared, _NOTE_DDL)))
    final = notes.unionByName(materialize(met(notes, slim, sent, _LIST_DDL).groupBy("bucket").applyInArrow(earlier, _NOTE_DDL)))
    return met(final, stage.select("block", "payload", "lengths", "docs", "row_doc", "row_text"), removed, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def _answers(table: pa.Table, kind: int, verdict) -> pa.Table:
    """For each block's list in one bucket, a bit for every entry, by the smallest document and the number of the entry's lists."""
    rows = table.select(["block", "bucket", "n", "ordinals", "docs"]).to_pylist()
    hashes = np.concatenate([unpacked(h.as_py(), np.uint64) for h in table.column("hashes")])
    ids = np.zeros(len(hashes), np.int64)
    ends = np.cumsum([r["n"] for r in rows])
    for row, end in zip(rows, ends.tolist(), strict=True):
        if row["ordinals"] is not None:
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ordinals"]), np.uint8).reshape(4, -1)
            ids[end - row["n"] : end] = unpacked(row["docs"], np.int64)[np.ascontiguousarray(planes.T).view(np.uint32).ravel()]
    order = np.argsort(hashes, kind="stable")
    new = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    counts = np.diff(new, append=len(hashes))
    lowest = np.minimum.reduceat(ids[order], new)
    said = np.zeros(len(hashes), bool)
    said[order] = verdict(np.repeat(lowest, counts), np.repeat(counts, counts), ids[order])
    out = [{"block": r["block"], "kind": kind, "bucket": r["bucket"], "bits": np.packbits(said[end - r["n"] : end]).tobytes()} for r, end in zip(rows, ends.tolist(), strict=True)]
    return pa.Table.from_pylist(out, schema=_NOTE)


def _kept(block: Block, row: dict, again: np.ndarray) -> Iterator[dict]:
    """The rows of a block, from the places of strings that an earlier document has."""
    steps = np.zeros(len(block.data) + 1, np.int32)
    steps[again] += 1
    steps[again + block.length] -= 1  # places are distinct
    gone = np.cumsum(steps[:-1]) > 0
    edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # A run that goes on from one text into the next is a run of each.
    borders = block.ends - block.lengths
    inner = borders[(borders > 0) & (borders < len(gone))]
    inner = np.unique(inner[gone[inner] & gone[inner - 1]])
    starts, stops = np.union1d(starts, inner), np.union1d(stops, inner)
    for doc, text in zip(row["row_doc"], row["row_text"], strict=True):
        n, end = int(block.lengths[text]), int(block.ends[text])
        at = end - n
        if n >= block.length and (doc > block.docs[text] or not block.live[text]):
            spans, kept = [{"start": 0, "end": n}], b""
        else:
            low, high = np.searchsorted(starts, [at, end]) if n else (0, 0)
            spans = [{"start": a - at, "end": b - at} for a, b in zip(starts[low:high].tolist(), stops[low:high].tolist(), strict=True)]
            kept = block.data[at:end][~gone[at:end]].tobytes()
        yield {"doc_id": None if doc == _NO_ID else doc, "n_bytes": n, "spans": spans, "kept": kept}


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the kept bytes, from ``repeats``."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
