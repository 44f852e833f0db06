"""Token ids in a binary file format: Simple-8b words in blocks of whole documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.encoding import encoder
from stratalens.session import materialize, shared_folder

# Selector 1 to 14: ids in a word, bits of each. Selector 15 announces a raw 64-bit word for an id that needs over 60 bits.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK_IDS = 65_536
STRIDE = 128  # words between two offsets
_CODEC = pa.Codec("zstd", compression_level=3)

SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<long>, lengths array<int>, raw array<int>, offsets array<int>, words binary"
# Index of the first width that holds an id, for the ids of common vocabularies.
_WIDTH = np.searchsorted([1 << bits for _, bits in PACKS], np.arange(1 << 16), "right").astype(np.uint8)
_COUNT = np.array([0] + [n for n, _ in PACKS] + [1], np.int64)
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int32())), ("raw", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary())])
_DOCS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit words of ``ids``, the places of raw words among them, and the ids before every ``STRIDE``-th word.

    Each word takes as many of the next ids as one selector can hold; the last word is filled up with zeros.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.int32), np.zeros(0, np.int32)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(60, np.uint64)])
    if padded.max() < len(_WIDTH):
        width = _WIDTH[padded.astype(np.int64)]
    else:
        width = sum((padded >= np.uint64(1 << bits)).astype(np.uint8) for _, bits in PACKS)
    widest = int(width.max())
    best = np.full(n, ESCAPE, np.uint8)
    too_wide = np.zeros(n + 61, np.int32)
    for selector in range(len(PACKS), 0, -1):
        if selector > widest:  # holds every id of the block
            best[:] = selector
            continue
        count = PACKS[selector - 1][0]
        np.cumsum(width > selector - 1, dtype=np.int32, out=too_wide[1:])
        best[too_wide[count : count + n] == too_wide[:n]] = selector
    step = _COUNT[best].tolist()
    starts = []
    at = 0
    while at < n:
        starts.append(at)
        at += step[at]
    place = np.array(starts, np.int64)
    chosen = best[place]
    escapes = chosen == ESCAPE
    index = np.arange(len(place)) + np.cumsum(escapes) - escapes
    words = np.zeros(len(place) + int(escapes.sum()), np.uint64)
    for selector in np.unique(chosen):
        here = chosen == selector
        tag = np.uint64(int(selector) << 60)
        if selector == ESCAPE:
            words[index[here]] = tag
            words[index[here] + 1] = padded[place[here]]
            continue
        count, bits = PACKS[selector - 1]
        parts = padded[place[here][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
        words[index[here]] = np.bitwise_or.reduce(parts, axis=1) | tag
    before = np.zeros(len(words), np.int64)
    before[index] = place
    before[index[escapes] + 1] = place[escapes]
    return words.astype("<u8"), (index[escapes] + 1).astype(np.int32), before[::STRIDE].astype(np.int32)


def decode_words(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, all words of a selector at a time."""
    words = words.astype(np.uint64)
    plain = np.ones(len(words), bool)
    plain[raw] = False
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(plain, _COUNT[selectors], 0)
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors[plain]):
        here = np.flatnonzero(plain & (selectors == selector))
        if selector == ESCAPE:
            out[place[here]] = words[here + 1]
            continue
        count, bits = PACKS[selector - 1]
        parts = (words[here][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        out[place[here][:, None] + np.arange(count)] = parts
    return out[:n]


def decode_range(words: np.ndarray, raw: np.ndarray, offsets: np.ndarray, n: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a block; only the words between the offsets around them are read."""
    end = min(end, n)
    if start >= end:
        return np.zeros(0, np.uint64)
    first = int(np.searchsorted(offsets, start, "right")) - 1
    last = int(np.searchsorted(offsets, end, "left"))
    low, high = first * STRIDE, min(last * STRIDE + 1, len(words))  # one more word: an escape's raw word may follow the group
    if low in set(raw.tolist()):  # the group starts with the raw word of an escape just before it
        low -= 1
    inside = raw[(raw >= low) & (raw < high)] - low
    part = words[low:high]
    if len(part) and int(part[-1] >> np.uint64(60)) == ESCAPE and len(part) - 1 not in inside:
        part = part[:-1]
    base = int(offsets[first])
    got = decode_words(part, inside, n - base)
    return got[start - base : end - base]


def _encoded(df: DataFrame, tokenizer: str, end: bytes) -> DataFrame:
    """(doc_id, mark, width, n, ids) of (doc_id, text), stored: ``n`` ids of ``width`` bytes, 2 where all are so small, else 4, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            parts = [_packed(ids + end) for ids in encode(batch.column(2))]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*parts, strict=True)) or [()] * 3, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "mark", "width", "n", "ids"])

    rows = df.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").selectExpr("doc_id", "xxhash64(text) mark", "text")
    return materialize(rows.mapInArrow(run, "doc_id long, mark long, width int, n int, ids binary"))


def _packed(ids: bytes) -> tuple[int, int, bytes]:
    whole = np.frombuffer(ids, "<u4")
    width = 2 if len(whole) and int(whole.max()) < 1 << 16 else 4
    return width, len(whole), _CODEC.compress(whole.astype(f"<u{width}").tobytes(), asbytes=True) if len(whole) else b""


def _unpacked(width: int, n: int, data: bytes) -> bytes:
    return np.frombuffer(_CODEC.decompress(data, n * width, asbytes=True), f"<u{width}").astype("<u4").tobytes() if n else b""


def _layout(encoded: DataFrame) -> DataFrame:
    """Encoded documents in shards of ascending doc_id; rows of one doc_id are ordered, and divided, by the hash of their text."""
    return encoded.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "n", "ids").select("doc_id", "width", "n", "ids")


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encodes ``df`` (doc_id, text) and writes a token file, a folder of blocks in ascending doc_id order.

    Texts are encoded where they are read; their ids, which are a third as large, are stored and dealt out by doc_id.

    A block is a row of its own: the documents in it and their lengths, its ids as 64-bit Simple-8b words, the places of
    raw words, and the ids before every 128th word, so that any range decodes without the words before it. A block
    closes at 65,536 ids and holds whole documents; one longer document makes a larger block. Spark's writer commits
    finished tasks only, so a lost executor leaves no half-written blocks.

    A null text is empty (the end id alone); equal rows are written as often as they occur; a null doc_id sorts first;
    an empty table makes an empty folder; other columns are ignored.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, first = 0, 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, first, docs, parts, held
            words, raw, offsets = encode_words(np.frombuffer(b"".join(parts), "<u4"))
            row = [shard, block, first, held, docs, [len(p) // 4 for p in parts], raw.tolist(), offsets.tolist(), words.tobytes()]
            block, first, docs, parts, held = block + 1, first + held, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc, *packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                docs.append(doc)
                parts.append(_unpacked(*packed))
                held += len(parts[-1]) // 4
                if held >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    _layout(_encoded(df, tokenizer, end)).mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file its first id's place among all ids, its number of ids, and their crc32."""
    blocks = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                lengths = np.array(row["lengths"].as_py(), np.int64)
                ids = decode_words(np.frombuffer(row["words"].as_buffer(), "<u8"), np.array(row["raw"].as_py(), np.int64), row["n_ids"].as_py())
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"].as_py()] * len(lengths), pa.int32()), row["doc_ids"].values,
                                                  pa.array(ends - lengths + row["first"].as_py()), pa.array(lengths), pa.array(sums, pa.int64())], schema=_DOCS)

    read = blocks.select("shard", "first", "n_ids", "doc_ids", "lengths", "raw", "words").mapInArrow(
        run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per shard: the running total is over as many rows as the file has shards.
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return read.join(before, "shard").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes a token file of ``df`` to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(df, path, tokenizer, end_id)
    return read_tokens(df.sparkSession, path)
