"""Benchmark items in documents, also with other numbers, names and units, by windows of templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.hashing import rolled
from stratalens.llm.pieces import Memory, grouped, words
from stratalens.llm.sift import bitmap, held, probably_in
from stratalens.session import materialize

# Words that stand for numbers, and units, which count as such after a number only.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty hundred thousand million half dozen twice".split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml litre litres liter liters "
         "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees "
         "meter meters metre metres centimeter centimeters kilometer kilometers kmh mph watt watts volt volts joule joules").split()

_LITERAL, _NUMBER, _UNIT, _NAME, _NONE, _ENDS = 0, 1, 2, 3, 4, 8
_SLOTS = np.array([xxhash.xxh64_intdigest(f"<{k}>") for k in ("", "number", "unit", "name")], np.uint64)
_DROP = re.compile(r"[\W_]+")
_NEW_LINE = 10
_NUMBER_WORDS, _UNITS = frozenset(NUMBER_WORDS), frozenset(UNITS)
LEVELS = (0, 1, 2)  # of windows, from the strictest
BITS = 24  # of the filter in front of the join: 2 MB whatever the size of the benchmark

SCHEMA = "row long, id long, window long, place int, slots array<string>, level int, token int, token_span int, run int, run_span int, inside boolean"
_ARROW = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("window", pa.int64()), ("place", pa.int32()), ("slots", pa.list_(pa.string())), ("level", pa.int32()), *((c, pa.int32()) for c in ("token", "token_span", "run", "run_span")), ("inside", pa.bool_())])


class _Words(Memory):
    """By word as written: the hash of its letters and digits, its kind, and whether a sentence ends with it."""

    def made(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(_word, pieces), np.uint64, len(pieces))


def _word(piece: bytes) -> int:
    text = piece.decode()
    word = text if text.isalnum() else _DROP.sub("", text)
    low = word.lower()
    if not word:
        kind = _NONE
    elif word[0].isdigit() or low in _NUMBER_WORDS:
        kind = _NUMBER
    elif word[0].isupper():
        kind = _NAME
    else:
        kind = _UNIT if low in _UNITS else _LITERAL
    ends = _ENDS if text == "\x00" or text.rstrip("\"')]")[-1:] in (".", "!", "?", ":") else 0
    return xxhash.xxh64_intdigest(low) & ~15 | kind | ends


_WORDS = _Words(1_500_000)


class Windows:
    """Hashes and first words of the windows of texts, their words, and per window its text, the span of template words and its level.

    The template has a number, unit or name in place of each such word; a name is a capitalised word that does not begin
    a sentence, and several in a row are one. Windows with a slot also come as plain words, so that a text with other
    capitals still meets the item. Windows with a capitalised word that begins a sentence come once more with all such
    words as names. Levels: 0 for windows without slots, 1 for those of the template, 2 with names that begin sentences.
    The words of several texts stand in a row and no window has words of two. Words and places are worked out when asked
    for: most texts have no window in question.
    """

    def __init__(self, texts: str | tuple[np.ndarray, np.ndarray], size: int, least_literals: int) -> None:
        buffer, bounds = texts if isinstance(texts, tuple) else next(grouped(pa.array([texts], pa.large_string())))
        starts, sizes = words(buffer, bounds)
        values = _WORDS.of(buffer, starts, sizes)
        flags = (values & np.uint64(15)).astype(np.int8)
        opens = np.zeros(len(starts) + 1, bool)
        opens[1:] = (flags & _ENDS) > 0
        opens[np.searchsorted(starts, np.flatnonzero(buffer == _NEW_LINE))] = True
        opens[np.searchsorted(starts, bounds)] = True
        at = np.flatnonzero((flags & 7) != _NONE)
        kind, opens, plain = (flags[at] & 7), opens[at], values[at] & np.uint64(2**64 - 16)
        self._buffer, self._starts, self._sizes = buffer, starts[at], sizes[at]
        self._bounds = np.searchsorted(self._starts, bounds)
        self._text = np.repeat(np.arange(len(bounds) - 1), np.diff(self._bounds))
        self._first = np.zeros(len(at) + 1, bool)  # the first word of each text
        self._first[self._bounds] = True
        self._first = self._first[:-1]
        after = np.where(self._first, _LITERAL, np.concatenate([[_LITERAL], kind[:-1]])) if len(at) else kind
        name = kind == _NAME
        slot = np.where(kind == _NUMBER, _NUMBER, np.where((kind == _UNIT) & (after == _NUMBER), _UNIT, np.where(name & ~opens, _NAME, 0)))
        self._slots = [slot, slot, slot]
        self._opens = opens
        hashes, spans, filled = self._template(slot, plain, size, least_literals)
        levels = (filled > 0).astype(np.int8)
        whole = rolled(plain, size)
        m = len(whole)
        any_slot = np.concatenate([[0], np.cumsum(slot > 0)])
        changed = np.flatnonzero((any_slot[size : size + m] - any_slot[:m] > 0) & (self._text[:m] == self._text[size - 1 : size - 1 + m]))
        parts = [(hashes, spans, levels), (whole[changed], np.stack([changed, changed + size], axis=1), np.zeros(len(changed), np.int8))]
        opening = name & opens
        if opening.any():
            self._slots[2] = np.where(opening, _NAME, slot)
            hashes, spans, _ = self._template(self._slots[2], plain, size, least_literals)
            openers = np.concatenate([[0], np.cumsum(opening)])
            more = openers[spans[:, 1]] - openers[spans[:, 0]] > 0
            parts.append((hashes[more], spans[more], np.full(int(more.sum()), 2, np.int8)))
        self.hashes, self.spans, self.levels = (np.concatenate(x) for x in zip(*parts, strict=True))

    @cached_property
    def words(self) -> list[str]:
        return [self._written(i) for i in range(len(self._starts))]

    @cached_property
    def _places(self) -> list[np.ndarray]:
        return [np.cumsum(self._kept(x)) for x in self._slots[1:]]

    def _written(self, word: int) -> str:
        start = self._starts[word]
        return self._buffer[start : start + self._sizes[word]].tobytes().decode()

    def _template(self, slot: np.ndarray, plain: np.ndarray, size: int, least_literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = np.flatnonzero(self._kept(slot))
        kinds = slot[keep]
        hashes = rolled(np.where(kinds > 0, _SLOTS[kinds], plain[keep]), size)
        n = len(hashes)
        filled = np.concatenate([[0], np.cumsum(kinds > 0)])
        filled = filled[size : size + n] - filled[:n]
        good = (size - filled >= least_literals) & (self._text[keep[:n]] == self._text[keep[size - 1 : size - 1 + n]])
        spans = np.stack([keep[:n], keep[size - 1 : size - 1 + n] + 1], axis=1) if n else np.zeros((0, 2), np.int64)
        return hashes[good], spans[good], filled[good]

    def _kept(self, slot: np.ndarray) -> np.ndarray:
        """All words but those that go on with a name."""
        goes_on = (slot[1:] == _NAME) & (slot[:-1] == _NAME) & ~self._opens[1:] & ~self._first[1:]
        return np.concatenate([[True], ~goes_on]) if len(slot) else np.zeros(0, bool)

    def place(self, window: int) -> tuple[int, int]:
        """The text of a window and its first word there."""
        start = int(self.spans[window, 0])
        text = int(self._text[start])
        return text, start - int(self._bounds[text])

    def places(self, window: int) -> list[int]:
        """The place of a window in the template and the number of places its words go on, without and with names that begin sentences."""
        start, end = self.spans[window].tolist()
        first = self._bounds[self._text[start]]
        return [int(x) for p in self._places for x in (p[start] - p[first] + 1, p[end - 1] - p[start])]

    def inside(self, window: int) -> bool:
        """Whether a window of the template starts inside a name whose first word begins a sentence."""
        start = self.spans[window, 0]
        return bool(self.levels[window] == 1 and start and self._places[1][start] == self._places[1][start - 1])

    def values(self, window: int) -> list[str]:
        """The words in the slots of a window."""
        level = self.levels[window]
        if not level:
            return []
        slot, opens = self._slots[level], self._opens
        start, end = self.spans[window].tolist()
        return [_DROP.sub("", self._written(i)).lower() for i in range(start, end) if slot[i] and not (slot[i] == _NAME and i > start and slot[i - 1] == _NAME and not opens[i])]


def _window_rows(df: DataFrame, id_column: str, size: int, least_literals: int, table: bytes | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            before = 0
            for texts in grouped(batch.column(2)):
                found = Windows(texts, size, least_literals)
                chosen = np.arange(len(found.hashes)) if table is None else np.flatnonzero(held(table, found.hashes))
                signed = found.hashes.view(np.int64)
                for i in chosen.tolist():
                    text, place = found.place(i)
                    out.append((rows[before + text], keys[before + text], int(signed[i]), place, found.values(i), int(found.levels[i]), *found.places(i), found.inside(i)))
                before += len(texts[1]) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 11, _ARROW, strict=True)], schema=_ARROW)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def matches(documents: DataFrame, benchmark: DataFrame, size: int = 8, least_literals: int = 5, least_windows: int = 6, least_share: float = 0.5) -> DataFrame:
    """Occurrences of ``benchmark`` items (item_id, text) in ``documents`` (doc_id, text): row, doc_id, item_id, n_windows, share, exact, first_word.

    Windows of ``size`` template words, with at least ``least_literals`` plain ones, are joined by hash. Windows of one
    document and item at one distance belong to one occurrence, whether the distance is one of words or, as names may
    differ in their number of words, one of places in the templates; it counts if it has ``least_windows`` windows or
    ``least_share`` of the item's, and if its slots are consistent: the same value of the item always stands against the
    same value of the document. Slots that are not consistent only put aside the windows that have them: those without
    names that begin sentences, or else those that agree word for word, decide then. ``exact`` tells whether all slots are equal. A bitmap of fixed size with the items'
    hashes keeps most windows from being moved; it lets through some that the join then drops, and none is lost.

    A null or empty text, and an item of fewer words than a window, has no windows; repeated rows are matched each;
    empty tables give no rows; other columns are ignored.
    """
    items = materialize(_window_rows(benchmark, "item_id", size, least_literals, None))
    totals = items.groupBy(F.col("row").alias("item_row")).agg(F.countDistinct("place").alias("total"))
    targets = items.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), "window", F.col("place").alias("item_place"), *[F.col(c).alias(f"item_{c}") for c in ("slots", "level", "token", "token_span", "run", "run_span", "inside")])
    hits = _window_rows(documents, "doc_id", size, least_literals, bitmap(items, "window", BITS))
    met = hits.join(targets, "window").withColumn("pairs", F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))).withColumn("level", F.greatest("level", "item_level"))
    # The whole name meets the other text's name by the window that starts with it.
    met = met.where((F.col("level") < LEVELS[-1]) | ~(F.col("inside") | F.col("item_inside")))
    by = ["row", "id", "item_row", "item_id"]
    # Gathered per occurrence, whose size the item's length bounds: windows and slots of each level and those under it.
    at_most = lambda value, k: F.collect_set(F.when(F.col("level") <= k, F.col(value)))
    apart = lambda c: F.mode(F.when((F.col(f"{c}_span") == F.col(f"item_{c}_span")) & (F.col(f"{c}_span") > 0), F.col(c) - F.col(f"item_{c}")), True)
    found = met.groupBy(*by, (F.col("place") - F.col("item_place")).alias("distance")).agg(
        *[at_most("item_place", k).alias(f"places{k}") for k in LEVELS], *[F.array_distinct(F.flatten(at_most("pairs", k))).alias(f"pairs{k}") for k in LEVELS],
        F.min("place").alias("first_word"), apart("token").alias("token"), apart("run").alias("run"))
    found = _merged(_merged(found, by, "token"), by, "run")
    found = found.join(totals, "item_row")
    share = lambda k: F.size(f"places{k}") / F.col("total")
    counts = lambda k: (_consistent(f"pairs{k}")) & ((F.size(f"places{k}") >= least_windows) | (share(k) >= least_share))
    best = F.coalesce(*[F.when(counts(k), F.struct(F.size(f"places{k}").cast("long").alias("n_windows"), share(k).alias("share"))) for k in reversed(LEVELS)])
    kept = found.withColumn("best", best).where("best is not null")
    same = ~F.exists(f"pairs{LEVELS[-1]}", lambda p: ~p["item"].eqNullSafe(p["doc"]))
    return kept.select("row", F.col("id").alias("doc_id"), "item_id", "best.n_windows", "best.share", same.alias("exact"), "first_word")


def _merged(found: DataFrame, by: list[str], distance: str) -> DataFrame:
    """Parts of occurrences that have one ``distance`` put together; those without it stay alone."""
    lists = [f"{c}{k}" for c in ("places", "pairs") for k in LEVELS]
    alone = F.when(F.col(distance).isNull(), F.col("distance")).alias("alone")
    most = F.struct(F.size(f"places{LEVELS[-1]}"), "distance")
    return found.groupBy(*by, distance, alone).agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in lists], F.min("first_word").alias("first_word"),
                                                   F.min("distance").alias("distance"), *[F.max_by(c, most).alias(c) for c in ("run",) if c != distance])


def _consistent(pairs: str) -> Column:
    """Whether each value of the item stands against one value of the document."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"]))) == F.size(pairs)


def leaks(documents: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """Per document and item with an occurrence: doc_id, item_id, the windows and share of the best one, and whether one is exact."""
    found = matches(documents, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("share").alias("share"), F.max("exact").alias("exact"), F.count("*").alias("n_places"))


def clean(documents: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``documents`` without those that hold an item; rows are told apart by doc_id, which may be null, and text.

    Only rows that pass a bitmap of the keys found are moved; the others go on from their input split.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = leaks(documents.select(key.alias("doc_id"), "text"), benchmark, **options)
    found = materialize(found.select(F.col("doc_id").alias("found_key")).distinct())
    hit = probably_in(found, "found_key")
    keyed = documents.select(F.struct("*").alias("given"), key.alias("key"))
    met = keyed.where(hit(F.col("key"))).join(found, F.col("key") == F.col("found_key"), "left_anti")
    return keyed.where(~hit(F.col("key"))).unionByName(met).select("given.*")
