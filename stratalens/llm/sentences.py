"""Removal of sentences that stand in repeated runs of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.hashing import mixed, rolled
from stratalens.session import materialize

# Stops before white space, full-width stops anywhere, line breaks.
_END = re.compile(r"[.!?]+[\"')\]]*\s+|(?:[\u3002\uff01\uff1f\uff61]|\uff0e(?!\d))+[\"')\]\u300d\u300f\u201d\u2019\uff09\u3011]*\s*|\n+")
# Scripts without blanks between words, whose characters count as words: Thai to Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")

SCHEMA = "row long, doc_id long, n_sentences int, sentence int, length int, run long"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_sentences", pa.int32()), ("sentence", pa.int32()), ("length", pa.int32()), ("run", pa.int64())])


def sentences(text: str, longest: int = 30) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of the sentences with a word; start and end in code points, the hash ignores case and marks.

    A sentence ends at a stop before white space, at a full-width stop or at a line break. In scripts without blanks
    every character is a word. One of over ``longest`` words is cut after every
    word whose own hash has three zero bits, so that the cuts inside a passage are the same wherever it stands.
    """
    out = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        words = list(_WORD.finditer(text, at, end))
        if len(words) > longest:
            low = [xxhash.xxh64_intdigest(w[0].lower()) for w in words]
            cut = [k + 1 for k, h in enumerate(low) if not h & 7 and k + 1 < len(words)]
            for a, b in zip([0, *cut], [*cut, len(words)], strict=True):
                stop = words[b].start() if b < len(words) else end
                out.append((at, stop, b - a, xxhash.xxh64_intdigest(" ".join(w[0].lower() for w in words[a:b]))))
                at = stop
        elif words:
            out.append((at, end, len(words), xxhash.xxh64_intdigest(" ".join(w[0].lower() for w in words))))
        at = end
    return out


def runs(found: list[tuple[int, int, int, int]], least_sentences: int, least_words: int, ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, length and hash of the shortest run from each sentence with enough sentences and words.

    With ``ends`` also those of the shortest run to each sentence: whatever longer run is repeated, these cover it.
    """
    words = np.array([x[2] for x in found], np.int64)
    hashes = np.array([x[3] for x in found], np.uint64)
    before = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(len(found))
    lengths = np.maximum(np.searchsorted(before, before[:-1] + least_words, "left") - first, least_sentences)
    fits = first + lengths <= len(found)
    if ends:
        last = np.arange(1, len(found) + 1)
        start = np.minimum(np.searchsorted(before, before[1:] - least_words, "right") - 1, last - least_sentences)
        new = start >= 0
        new[new] = lengths[start[new]] != (last - start)[new]
        first, lengths = np.concatenate([first[fits], start[new]]), np.concatenate([lengths[fits], (last - start)[new]])
    else:
        first, lengths = first[fits], lengths[fits]
    out = np.zeros(len(first), np.uint64)
    for n in np.unique(lengths):
        here = lengths == n
        out[here] = mixed(rolled(hashes, int(n))[first[here]] + np.uint64(n))
    return first, lengths, out


def repeated(df: DataFrame, least_sentences: int = 2, least_words: int = 15, row: str | None = None, ends: bool = False) -> DataFrame:
    """Per row of ``df`` (doc_id, text) that loses sentences: row, doc_id, n_sentences, n_removed, sentences, first_docs.

    The shortest run of at least ``least_sentences`` consecutive sentences with ``least_words`` words from every sentence
    is hashed, with ``ends`` also the one to every sentence, without which the end of a passage may stay; of equal runs in all documents the first is the one with the smallest (doc_id, row, sentence), and the
    sentences of all others are removed. ``sentences`` has their numbers, ``first_docs`` the documents of the first
    runs. Rows are numbered, or take the number in the column ``row``. Counting is a partial aggregate by run; its result, the repeated runs only, is joined back, where Spark splits
    a run that very many documents have. A document's own runs are all that is ever gathered.

    A null or empty text has no runs; of equal rows all but the first lose all their sentences (if they have a whole
    run); an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], [], [], [], []]
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                found = sentences(text.as_py() or "")
                if len(found) < least_sentences:
                    continue
                first, lengths, hashes = runs(found, least_sentences, least_words, ends)
                for part, value in zip(parts, (row, doc, len(found)), strict=False):
                    part += [value] * len(first)
                for part, values in zip(parts[3:], (first, lengths, hashes.astype(np.int64)), strict=True):
                    part.append(values)
            arrays = [pa.array(p, f.type) for p, f in zip(parts[:3], _ARROW, strict=False)]
            arrays += [pa.array(np.concatenate(p) if p else [], f.type) for p, f in zip(parts[3:], list(_ARROW)[3:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    rows = df.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(rows.mapInArrow(run, SCHEMA))
    place = F.struct("doc_id", "row", "sentence")
    again = found.groupBy("run").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") > 1).select("run", "first")
    later = found.join(again, "run").where(place != F.col("first"))
    covered = later.select("row", "doc_id", "n_sentences", F.col("first.doc_id").alias("first_doc"), F.explode(F.sequence("sentence", F.col("sentence") + F.col("length") - 1)).alias("sentence"))
    out = covered.groupBy("row", "doc_id", "n_sentences").agg(F.sort_array(F.collect_set("sentence")).alias("sentences"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    return out.select("row", "doc_id", "n_sentences", F.size("sentences").alias("n_removed"), "sentences", "first_docs")


def removed(df: DataFrame, least_sentences: int = 2, least_words: int = 15, ends: bool = False) -> DataFrame:
    """``df`` without the sentences that ``repeated`` names; a text that keeps none is empty, other columns stay."""
    stage = materialize(df.select(F.struct("*").alias("given"), F.monotonically_increasing_id().alias("id")))
    texts = stage.select("id", "given.doc_id", "given.text")
    lost = repeated(texts, least_sentences, least_words, row="id", ends=ends).select(F.col("row").alias("id"), "sentences")

    @F.pandas_udf("string")
    def without(texts, numbers):
        import pandas as pd

        out = []
        for text, gone in zip(texts, numbers, strict=True):
            if gone is not None and text is not None:
                drop = set(gone.tolist())
                text = "".join(text[a:b] for k, (a, b, _, _) in enumerate(sentences(text)) if k not in drop)
            out.append(text)
        return pd.Series(out, dtype=object)

    given = F.col("given.text")
    text = F.when(F.col("sentences").isNull(), given).otherwise(without(given.cast("string"), "sentences"))
    return stage.join(lost, "id", "left").select(*[text.alias(c) if c == "text" else F.col("given").getField(c).alias(c) for c in df.columns])
