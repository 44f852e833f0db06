"""Spelling variants of a vocabulary by pivotal bigrams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.components import settled
from stratalens.session import materialize

_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HELD = 300_000  # words that a task counts before it passes them on
_LONG = 64  # longer words are indexed by their halves

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_SIGNED = pa.schema([("key", pa.int64()), ("indexed", pa.bool_()), ("word", pa.string()), ("letters", pa.int64())])


def words(df: DataFrame, rate: int = 97) -> DataFrame:
    """(word, n) of the letter runs in ``df`` (doc_id, text), every ``rate``-th kind of run of a document by hash with a letter missing.

    Runs are lower-cased in A to Z only. Let h be the unsigned crc32 of ``<doc_id>:<run>``: where ``rate`` divides it, the
    run's letter number h modulo its length goes. Every task adds up its own counts first. A null text has no runs, a
    null doc_id is written as nothing; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found, n in Counter(_RUN.findall(text.as_py() or "")).items():
                    low = found.lower() if found.isascii() else found.translate(_LOWER)
                    h = zlib.crc32(low.encode(), start)
                    if not h % rate:
                        at = h % len(low)
                        low = low[:at] + low[at + 1 :]
                    held[low] += n
                if len(held) > _HELD:
                    yield counted()
                    held.clear()
        yield counted()

    given = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(grams: list[tuple[int, int]], wanted: int = 2, width: int = 2) -> list[int]:
    """Numbers of the ``wanted`` grams (place, weight), ascending by place, that do not overlap and weigh least together.

    By dynamic programming: the best choice of k grams among the first i either leaves the i-th out or takes it with the
    best choice of k - 1 among those that end before it. Empty if there are not so many.
    """
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(grams) + 1)]
    for _ in range(wanted):
        row: list[tuple[float, tuple[int, ...]]] = [(float("inf"), ())]
        free = 0  # grams that end before the current one
        for i, (place, weight) in enumerate(grams):
            while grams[free][0] + width <= place:
                free += 1
            total, chosen = best[-1][free]
            row.append(min(row[-1], (total + weight, (*chosen, i))))
        best.append(row)
    return list(best[-1][-1][1])


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\t".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def signatures(word: str, weights: Mapping[str, int]) -> tuple[set[int], set[int]]:
    """Keys under which a word is indexed, and keys that it looks up.

    For any two words that differ by one inserted, deleted or replaced letter, one looks up a key of the other. The prefix
    of a word are its three rarest bigrams, with ties, so it has two disjoint ones: the pivots. One edit changes one
    pivot at most. Of two near words take the one whose prefix reaches further in the order of rarity: the other's unchanged
    pivot is in it. If the edit is behind the pivot, its place from the start is the same and so is all before it; if the
    edit is in front, its place from the end is the same and so is all after it. So a key has a pivot's place and that
    part of the word, and the word's length. A word of over 64 letters is indexed by its halves, of which one is unchanged.
    """
    n = len(word)
    if n > _LONG:
        half = n // 2
        indexed = {_key("first", n, word[:half]), _key("last", n, word[half:])}
        return indexed, {k for m in (n - 1, n, n + 1) for k in _halves(word, m)}
    grams = sorted((weights[word[i : i + 2]], word[i : i + 2], i) for i in range(n - 1))
    prefix = sorted((x for x in grams if x[:2] <= grams[min(2, len(grams) - 1)][:2]), key=lambda x: x[2])
    places = [at for _, _, at in prefix]
    chosen = [places[k] for k in pivots([(at, weight) for weight, _, at in prefix])]
    indexed = {_key(*x) for at in chosen for x in (("to", n, word[: at + 2]), ("from", n, word[at:]))}
    looked = {_key(*x) for at in places for m in (n - 1, n, n + 1) for x in (("to", m, word[: at + 2]), ("from", m, word[at:]))}
    if n == _LONG:
        looked.update(_halves(word, n + 1))  # its longer neighbours are indexed by halves
    return indexed, looked


def _halves(word: str, m: int) -> tuple[int, int]:
    """Keys of the halves of a word of ``m`` letters that may be near."""
    return _key("first", m, word[: m // 2]), _key("last", m, word[len(word) - (m - m // 2) :])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b), both ways, of the distinct words in ``vocabulary`` (word) that differ by exactly one letter.

    Words need four letters at least. Keys of the index meet keys looked up in one join; a pair that also has all but two
    kinds of letters in common is verified at once, so only near pairs go on. The weights of bigrams, the driver's share, are bounded
    by the square of the alphabet of ``words``. An empty vocabulary gives no rows.
    """
    spread = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    weights = {r.gram: r.n for r in spread.groupBy("gram").agg(F.count("*").alias("n")).collect()}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, bool, str, int]] = []
            for word in batch.column(0).to_pylist():
                indexed, looked = signatures(word, weights)
                letters = 0
                for letter in set(word):
                    letters |= 1 << (ord(letter) & 63)
                rows += [(k, True, word, letters) for k in indexed]
                rows += [(k, False, word, letters) for k in looked]
            keys, sides, found, masks = zip(*rows, strict=True) if rows else ((), (), (), ())
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([as_long(keys), pa.array(sides, pa.bool_()), pa.array(found, pa.string()), as_long(masks)], schema=_SIGNED)

    signed = materialize(vocabulary.select("word").mapInArrow(sign, "key long, indexed boolean, word string, letters long"))
    x, y = signed.where("indexed").alias("x"), signed.where("not indexed").alias("y")
    alike = F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters"))) <= 2
    close = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & alike & close).select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b")).distinct()
    pairs = materialize(pairs)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def forms(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """Per row of ``vocabulary`` (word, n): word, n, n_near, form, form_n, root.

    ``form`` is the near word with the largest n (of several the smallest in code-point order) if that is at least
    ``times`` the word's own, else null; ``root`` is the word at the end of the forms that follow one another, the word
    itself if it has none. Every form is more frequent than its word, so chains end, and their steps double each round.
    """
    given = materialize(vocabulary.select("word", "n"))
    near = near_pairs(given).join(given.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("order"), F.col("b").alias("form"))).alias("best"))
    told = given.join(best, "word", "left").withColumn("form_n", -F.col("best.order")).withColumn("taken", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    stage = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), F.col("best.form")).alias("form"), F.when(F.col("taken"), F.col("form_n")).alias("form_n")))
    steps = settled(stage.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("root"))).withColumnRenamed("node", "word")
    return stage.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(df: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """``forms`` of the words of ``df`` (doc_id, text) with enough letters and occurrences."""
    return forms(words(df).where((F.length("word") >= least_letters) & (F.col("n") >= least_n)))
