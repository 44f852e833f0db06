"""Similarity join of shingle sets by PartEnum signatures, and the groups it links."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.components import connected
from stratalens.llm.hashing import WordHashes, mixed, rolled
from stratalens.llm.sift import probably_in
from stratalens.session import materialize

_LARGEST = 1 << 40
_SEEDS = 24
_SPLIT = 256  # documents compared with one other in one piece of work
_WORDS = 8  # of 64 bits in a parity sketch
_SKETCH = [f"s{k}" for k in range(_WORDS)]
_HASHES = WordHashes()

_STAGE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), *((c, pa.int64()) for c in _SKETCH), ("signatures", pa.list_(pa.int64()))])


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; fewer words are one run; words are divided by ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(_HASHES.of(words), min(size, len(words))))


def linked(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """Whether two sets have ``part / whole`` of their union in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or whole * len(small) < part * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    common = int((large[place] == small).sum())
    return whole * common >= part * (len(a) + len(b) - common)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in 512 buckets, as 64-bit words.

    Two sketches differ in no more bits than their sets have elements that only one has.
    """
    bucket = (mixed(elements ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * _WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=64 * _WORDS) & 1).astype(np.uint8)).view(np.int64)


def _may_link(x: str, y: str, part: int, whole: int) -> Column:
    """Whether the sketches of rows ``x`` and ``y`` allow the similarity: no similar pair fails."""
    bits = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _SKETCH), F.lit(0))
    return bits * (whole + part) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (whole - part)


class PartEnum:
    """Signatures such that any two sets with ``part / whole`` of their union in common share one.

    Sizes fall into bands whose ends differ by the ratio, so the larger of two similar sets is in the smaller one's band
    or the next. For a band, two such sets differ in at most ``k`` elements. The elements are divided by hash into
    ``k + 1 + e`` parts: at least ``e + 1`` of them hold no difference, and a set signs with the contents of every part.
    Empty parts are no signatures. If one of the sets has at most ``e`` empty parts, one of the equal parts is not
    empty and is shared. A set with more empty parts signs once more under another division, until one has at most
    ``e``; the set that stops first guarantees the shared part. This is PartEnum with one part in each enumerated
    subset, the choice that signs least at this similarity.
    """

    def __init__(self, part: int, whole: int) -> None:
        self.starts = [1]
        self.parts: list[tuple[int, int]] = []  # per band: number of parts, empty ones a set may have
        while self.starts[-1] < _LARGEST:
            low = self.starts[-1]
            high = low * whole // part
            k = 2 * (whole - part) * high // (whole + part)
            least = max(1, -(-part * low // whole))  # size of the smallest partner
            spare = 0 if k == 0 else 1 + math.ceil(1.5 * (k + 1) * math.exp(-least / (k + 1)))
            self.parts.append((k + 1 + spare, spare))
            self.starts.append(high + 1)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of a set of 64-bit elements, for its band and as the smaller partner for the next one."""
        if not len(elements):
            return np.zeros(0, np.uint64)
        band = bisect_right(self.starts, len(elements)) - 1
        return np.concatenate([self._sign(elements, band), self._sign(elements, band + 1)])

    def _sign(self, elements: np.ndarray, band: int) -> np.ndarray:
        n, spare = self.parts[band]
        out = []
        for seed in range(_SEEDS + 1):
            tag = np.uint64(((band << 8 | seed) + 1) * 0x632BE59BD9B4E019 & 2**64 - 1)
            scattered = mixed(elements ^ tag)
            part = ((scattered >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            contents = mixed(scattered)
            low = np.bincount(part, (contents & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
            high = np.bincount(part, (contents >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
            filled = np.bincount(part, minlength=n) > 0
            signed = mixed((high << np.uint64(32)) + low + mixed(np.arange(n, dtype=np.uint64) + tag))
            last = n - int(filled.sum()) <= spare
            out.append(signed if seed == _SEEDS and not last else signed[filled])  # at last, empty parts sign too
            if last:
                break
        return np.concatenate(out)


def _signed(df: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(part, whole)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                keys, sketches, signatures, lengths = [], [], [], [0]
                for text in some.column(3):
                    found = shingles(text.as_py(), size)
                    scattered = mixed(found)
                    signed = scheme.signatures(found)
                    keys.append((len(found), int(scattered.sum(dtype=np.uint64).view(np.int64)), int(mixed(scattered).sum(dtype=np.uint64).view(np.int64))))
                    sketches.append(sketch(found))
                    signatures.append(signed)
                    lengths.append(lengths[-1] + len(signed))
                values = pa.array(np.concatenate(signatures).view(np.int64))
                bits = np.stack(sketches)
                yield pa.RecordBatch.from_arrays([*some.columns[:3], *(pa.array(c, pa.int64()) for c in zip(*keys, strict=True)), *(pa.array(bits[:, k]) for k in range(_WORDS)),
                                                  pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)], schema=_STAGE)

    schema = f"row long, doc_id long, text_key long, n long, k1 long, k2 long, {', '.join(f'{c} long' for c in _SKETCH)}, signatures array<long>"
    return df.mapInArrow(run, schema)


def _given(df: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _compared(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """The ``pairs`` (a, b) of rows whose sets are similar enough, by the sets of their ``texts`` (row, text).

    First, pairs go that the sketches in ``sets`` rule out.
    All partners of a ``b`` follow it in one stream, at most some hundreds to a piece, so its set is made once a piece
    and a task holds two sets.
    """
    x, y = sets.alias("x"), sets.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.row")).join(y, F.col("b") == F.col("y.row"))
    pairs = materialize(both.where(_may_link("x", "y", part, whole)).select("a", "b"))
    pieces = pairs.groupBy("b").agg(F.ceil(F.count("*") / _SPLIT).cast("int").alias("pieces"))
    heads = pieces.join(texts, F.col("b") == F.col("row")).select("b", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), "row", "text")
    rest = pairs.join(pieces, "b").join(texts, F.col("a") == F.col("row")).select("b", F.pmod(F.hash("a"), F.col("pieces")).alias("piece"), F.lit(1).alias("kind"), "row", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            b, piece, kind, row = (batch.column(k).to_pylist() for k in range(4))
            for i, text in enumerate(batch.column(4)):
                if kind[i] == 0:
                    if head != (b[i], piece[i]):
                        head, held = (b[i], piece[i]), shingles(text.as_py(), size)
                elif linked(shingles(text.as_py(), size), held, part, whole):
                    found.append((row[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found, strict=True)) or [(), ()]], schema=schema)

    rows = heads.unionByName(rest).repartition("b", "piece").sortWithinPartitions("b", "piece", "kind")
    return rows.mapInArrow(run, "a long, b long").distinct()


def groups(df: DataFrame, size: int = 4, part: int = 85, whole: int = 100) -> DataFrame:
    """Per row of ``df`` (doc_id, text): row, doc_id, text_key, n_shingles, component_id, first_row.

    Two texts are linked if their sets of distinct ``size``-word shingles have ``part / whole`` of their union in common;
    ``component_id`` is the smallest doc_id that links lead to (null if all are null), ``first_row`` one row with it. Equal sets are one class
    and only its first member goes on. Candidates share a PartEnum signature. Each is compared first with the smallest
    member of its signatures; then, where members of a signature are still in different components, with the smallest
    member of each such signature; and then those still apart, with one another. Every comparison is exact, and a pair
    is left out only when its members are already linked or their parity sketches differ in more bits than similar sets
    can differ in elements.

    The hashes of shingles have 64 bits, sets are told apart by their size and two such sums. A null or empty text has
    no shingles and is linked with nothing; equal texts, also of one doc_id, are one class; an empty table gives no
    rows; other columns are ignored.
    """
    given = _given(df)
    stage = materialize(_signed(given.select(F.monotonically_increasing_id().alias("row"), "*"), size, part, whole))
    equal = stage.where(F.col("n") > 0).groupBy("n", "k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "text_key", *_SKETCH)).alias("first"))
    classes = materialize(equal.select("n", "k1", "k2", "first.*").drop("unnamed"))
    single = stage.select("row", "signatures").join(classes.select("row"), "row", "left_semi")
    signed = single.select("row", F.explode("signatures").alias("signature"))
    # Sorted by signature and row, the first row of a signature is known when the others pass: nothing is gathered.
    order = Window.partitionBy("signature").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    shared = materialize(signed.withColumn("first", F.first("row").over(order)).where(F.col("row") != F.col("first")))

    nearest = shared.groupBy(F.col("row").alias("a")).agg(F.min("first").alias("b"))
    ends = shared.select("row").union(shared.select("first")).distinct()
    wanted = materialize(classes.join(ends, "row").select("row", "doc_id", "text_key", "n", *_SKETCH))
    sets = wanted.select("row", "n", *_SKETCH)
    texts = materialize(given.where(probably_in(wanted, "text_key")(F.col("text_key"))).alias("g").join(wanted.alias("w"), _same("g.doc_id", "w.doc_id", "g.text_key", "w.text_key")).select("row", "text").dropDuplicates(["row"]))
    compare = lambda pairs: materialize(_compared(pairs, sets, texts, size, part, whole))

    edges = compare(nearest)
    labels = connected(edges)
    apart = materialize(_apart(shared, labels))
    further = apart.select(F.col("row").alias("a"), F.col("first").alias("b")).distinct().join(nearest, ["a", "b"], "left_anti")
    more = compare(further)
    if not more.isEmpty():
        edges = edges.unionByName(more)
        labels = connected(edges)
    # Members of a signature that the first one did not bring together.
    still = shared.join(apart.select("signature").distinct(), "signature", "left_semi").select("signature", "row", "first")
    members = still.select("signature", "row").union(still.select("signature", F.col("first").alias("row"))).distinct()
    members = materialize(_labelled(members, labels))
    mixed_ones = members.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("signature")
    members = members.join(mixed_ones, "signature", "left_semi").join(sets, "row")
    left, right = members.alias("x"), members.alias("y")
    other = (F.col("x.row") > F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", part, whole)
    crossed = left.join(right, (F.col("x.signature") == F.col("y.signature")) & other)
    tested = nearest.unionByName(further)
    rest = compare(crossed.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = connected(edges.unionByName(rest))

    rooted = _labelled(classes, labels)
    lowest = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("lowest"))
    known = rooted.join(lowest, "root").select("n", "k1", "k2", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row").alias("first_row"))
    out = stage.drop("signatures", *_SKETCH).join(known, ["n", "k1", "k2"], "left")
    return out.select("row", "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(F.col("n") > 0, F.col("first_row")).otherwise(F.col("row")).alias("first_row"))


def _same(id_: str, other_id: str, key: str, other_key: str) -> Column:
    """Whether doc_id, which may be null, and text are the same."""
    return F.col(id_).eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with the root of each, the row itself where nothing is linked to it."""
    return rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def _apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``shared`` whose first member is in another component."""
    firsts = labels.select(F.col("node").alias("first"), F.col("root").alias("first_root"))
    found = _labelled(shared, labels).join(firsts, "first", "left")
    return found.where(F.col("root") != F.coalesce("first_root", "first")).select("signature", "row", "first")


def deduplicated(df: DataFrame, size: int = 4, part: int = 85, whole: int = 100) -> DataFrame:
    """``df`` with one row of each group of ``groups``, one with the smallest doc_id; texts without words all stay.

    Only texts that share a key with a row to be dropped are moved; all others pass from their input split.
    """
    found = materialize(groups(df, size, part, whole))
    firsts = found.where("n_shingles > 0").groupBy("first_row").agg(F.count("*").alias("n")).where("n > 1").select("first_row")
    members = materialize(found.where("n_shingles > 0").join(firsts, "first_row").select("doc_id", "text_key", (F.col("row") == F.col("first_row")).alias("keep")))
    verdicts = members.groupBy(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).agg(F.max("keep").alias("keep"))
    hit = probably_in(members, "text_key")
    # The row is one column, so that none of its names can clash.
    keyed = df.select(F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    rest = keyed.where(~hit(F.col("key")))
    met = keyed.where(hit(F.col("key"))).join(verdicts, _same("id", "found_id", "key", "found_key"), "left")
    once = met.where("keep").dropDuplicates(["id", "key"])
    return rest.select("given.*").unionByName(met.where("keep is null").select("given.*")).unionByName(once.select("given.*"))
