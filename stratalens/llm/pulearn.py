"""A quality score learnt from trusted positives and unlabelled texts by the non-negative unbiased risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.session import materialize

_SYMBOL, _BANG, _UPPER, _DIGIT, _LETTER, _END, _COMMA, _LINE, _BLANK, _HIGH, _OTHER = range(11)
_CLASS = np.full(256, _OTHER, np.int64)
for _chars, _kind in ((b"#*$%&|<>{}[]\\^~_=+/@", _SYMBOL), (b"!", _BANG), (bytes(range(65, 91)), _UPPER), (bytes(range(48, 58)), _DIGIT), (bytes(range(97, 123)), _LETTER),
                      (b".?", _END), (b",;:", _COMMA), (b"\n", _LINE), (b" \t\r\x0b\x0c", _BLANK), (bytes(range(128, 256)), _HIGH)):
    _CLASS[list(_chars)] = _kind

FEATURES = ["log_words", "word_bytes", "symbols", "bangs", "upper", "digits", "ends", "commas", "lines", "high", "distinct_words", "top_word", "distinct_lines",
            "top_pair", "log_line_words"]


def features(text: str) -> list[float]:
    """Form and repetition of a whole text as numbers; all zero for a text without words."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=11)
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    return [float(np.log1p(n)), sum(map(len, words)) / n, kinds[_SYMBOL] / n, kinds[_BANG] / n, kinds[_UPPER] / size, kinds[_DIGIT] / size, kinds[_END] / n,
            kinds[_COMMA] / n, kinds[_LINE] / n, kinds[_HIGH] / size, len(counts) / n, max(counts.values()) / n, len(set(lines)) / len(lines),
            max(pairs.values(), default=0) / n, float(np.log1p(n / len(lines)))]


def _featured(df: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py() or "") for t in batch.column(1)], schema[1].type)], schema=schema)

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, x array<double>")


class Basis:
    """Indicators of the intervals between a feature's cut points, all features side by side, and a constant."""

    def __init__(self, cuts: list[np.ndarray]) -> None:
        self.cuts = cuts
        self.starts = np.cumsum([1] + [len(c) + 1 for c in cuts])
        self.size = int(self.starts[-1])

    def places(self, x: np.ndarray) -> np.ndarray:
        """Per row the indicators that are one."""
        out = np.zeros((len(x), len(self.cuts) + 1), np.int64)
        for k, cuts in enumerate(self.cuts):
            out[:, k + 1] = self.starts[k] + np.searchsorted(cuts, x[:, k], "right")
        return out


def _moments(df: DataFrame, basis: Basis) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows of ``df`` (x), and the means of the basis and of its products; a task gives one set of sums."""
    d = basis.size
    schema = pa.schema([("i", pa.int64()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d)
        for batch in batches:
            if batch.num_rows:
                at = basis.places(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
                total += np.bincount((at[:, :, None] * d + at[:, None, :]).ravel(), minlength=d * d)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], schema=schema)

    sums = df.select("x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # at most d * d rows
    products = np.zeros(d * d)
    for row in sums:
        products[row.i] = row.s
    products = products.reshape(d, d)
    n = products[0, 0]  # the constant with itself
    return n, products[0] / max(n, 1), products / max(n, 1)


def fit_moments(prior: float, positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], ridge: float = 1e-3, steps: int = 3000) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk under the squared loss (1 - y z)^2 / 4.

    The loss is quadratic, so the risk needs no rows, only means: it starts from the minimum of the unbiased risk and
    goes down the non-negative one; where the estimated risk of the negatives falls below zero, that part is undone.
    """
    (bp, ap), (bu, au) = positive, unlabelled
    d = len(bp)
    w = np.linalg.solve(au + ridge * np.eye(d), 2 * prior * bp - bu)
    rate = 1.0 / max(np.linalg.norm(au, 2), np.linalg.norm(ap, 2), 1e-9)
    best, best_risk = w, np.inf
    for _ in range(steps):
        plus = (1 - 2 * bp @ w + w @ ap @ w) / 4
        minus = (1 + 2 * bu @ w + w @ au @ w) / 4 - prior * (1 + 2 * bp @ w + w @ ap @ w) / 4
        risk = prior * plus + max(0.0, minus) + ridge * (w @ w) / 4
        if risk < best_risk:
            best, best_risk = w, risk
        down_plus = prior * (ap @ w - bp) / 2
        down_minus = (bu + au @ w) / 2 - prior * (bp + ap @ w) / 2
        w = w - rate * (down_plus + down_minus + ridge * w / 2 if minus >= 0 else -down_minus)
    return best


def fold(doc_id: Column) -> Column:
    """True for the rows held out: crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, bins: int = 12, default_prior: float = 0.5) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): held_out, score, predicted.

    Positives are the texts with quality 1 outside the held-out fold; the unlabelled texts are all documents outside it,
    labelled or not. The class prior is the share of quality 1 among the labels outside the fold, ``default_prior``
    without labels. Features of whole texts are stored once; their cut points are quantiles, and the risk's means sums,
    over all rows. Nothing is sampled; the driver receives cut points and one matrix of the size of the basis.

    The score is a smooth form of the estimated probability. A null or empty text has all features zero; labels of a
    document given more than once count as positive if one of them is; without positives all scores are one half; an
    empty table gives no rows; other columns are ignored.
    """
    stage = materialize(_featured(documents))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~fold(F.col("doc_id")) & F.col("quality").isNotNull())
    known = materialize(known.groupBy("doc_id").agg(F.max("quality").alias("quality")))
    prior = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = default_prior if prior is None else min(max(prior, 0.01), 0.99)
    unlabelled = stage.where(~fold(F.col("doc_id")))
    spread = [F.percentile_approx(F.col("x")[k], [i / bins for i in range(1, bins)], 10_000).alias(f"f{k}") for k in range(len(FEATURES))]
    found = unlabelled.agg(*spread).first()
    basis = Basis([np.unique(np.array(c or [], float)) for c in found])
    n_u, bu, au = _moments(unlabelled, basis)
    n_p, bp, ap = _moments(stage.join(known.where(F.col("quality") == 1), "doc_id", "left_semi"), basis)
    weights = fit_moments(prior, (bp, ap), (bu, au)) if n_u and n_p else np.zeros(basis.size)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = weights[basis.places(np.stack(batch.column(1).to_numpy(zero_copy_only=False)))].sum(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-2 * z)))], schema=schema)

    scored = stage.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
