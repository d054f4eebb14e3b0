"""Quality scores from preference pairs (Bradley-Terry), calibrated and cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linetriage.llm.learning import SAMPLE, Differences, calibration, labelled_sample, logistic, products, remainder, sigmoid

PAIRS = 16_000  # preference pairs of a fit, at most
GRADES = 10_000  # score steps of the quantile's histogram
CLASSES = 8
SHAPES = CLASSES**3
EXTRA = 8
WIDTH = SHAPES + EXTRA


def _classes() -> np.ndarray:
    """0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 other ASCII mark."""
    kind = np.zeros(0x3000, np.uint16)
    for c in range(0x3000):
        s = chr(c)
        kind[c] = 2 if s.isupper() else 1 if s.isalpha() else 3 if s.isdigit() else 5 if s == "\n" else 4 if s.isspace() else (
            6 if s in ".,;:?'\"()-" else 7 if c < 128 else 0)
    return kind


_KIND = _classes()


def features(text: str) -> np.ndarray:
    """Square roots of the shares of class trigrams, and how much words and lines repeat."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(WIDTH, np.float32)
    if len(codes) >= 3:
        kind = _KIND[np.minimum(codes, 0x2FFF)]
        seen = np.bincount(kind[:-2] * CLASSES * CLASSES + kind[1:-1] * CLASSES + kind[2:], minlength=SHAPES)
        out[:SHAPES] = np.sqrt(seen / (len(codes) - 2))
    words, lines = text.split(), [s for s in text.split("\n") if s]
    n = len(words)
    out[SHAPES:] = (
        len(set(words)) / n if n else 0,
        np.log1p(n) / 10,
        np.log1p(len(codes) / n) / 3 if n else 0,
        len(set(lines)) / len(lines) if lines else 0,
        np.log1p(len(codes) / max(1, len(lines))) / 10,
        len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1,
        1.0 if n < 5 else 0.0,
        1.0 if n else 0.0,
    )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights) + self.offset)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, pairs: int = PAIRS, penalty: float = 1.0) -> Model:
    """Learn from preference pairs: each labelled good document is preferred to each labelled bad one.

    The fit reads at most about ``rows`` labelled documents and ``pairs`` of their pairs; their features
    (fixed width) are all that reaches the driver. Without rows of both labels every score is the label
    share, or one half without any label.
    """
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", 3) != 1, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), batch.column(2)], names=["doc_id", "x", "label"])

    seen = sample.mapInArrow(run, "doc_id long, x binary, label int").toPandas().sort_values(["doc_id", "label", "x"])
    y = seen.label.to_numpy().astype(int)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(WIDTH), 0.0, float(np.log(share / (1 - share))))
    x = np.frombuffer(b"".join(seen.x), np.float32).reshape(len(y), WIDTH)
    del seen
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(2)
    left, right = draw.choice(good, pairs), draw.choice(bad, pairs)
    weights = logistic(Differences(x, left, right), np.ones(pairs), np.full(WIDTH, penalty))
    slope, offset = calibration(products(x, weights, len(y)), y)
    return Model(weights, slope, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text).

    A null text counts as empty; empty texts are scored like any other. Repeated rows and null doc_ids
    give a row each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = model.score(np.array([features(t or "") for t in part.column(1).to_pylist()], float))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, score double, predicted int")


def _steps(scores: DataFrame, grades: int) -> list[tuple[int, int]]:
    """Rows per score step, in order. Counts combine before the shuffle; their number is fixed, so they may go to the driver."""
    counts = scores.groupBy(F.least(F.floor(F.col("score") * grades), F.lit(grades - 1)).alias("step")).count().collect()
    return sorted((r["step"], r["count"]) for r in counts)


def quantile_of(scores: DataFrame, share: float, grades: int = GRADES) -> float:
    """The largest of ``grades`` score steps that at most ``share`` of all rows lie below."""
    counts = _steps(scores, grades)
    total, below, cut = sum(n for _, n in counts), 0, 0
    for step, n in counts:
        if below > share * total:
            break
        cut = step
        below += n
    return cut / grades


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def cut_at(docs: DataFrame, model: Model) -> float:
    """The score below which documents go: the quantile at the share of all ``docs`` that score below one half.

    That share is counted on ``docs``, not taken from the fit, so it cannot fall among rejected documents:
    those that ``score`` predicts 0 go and all others stay, whatever their share. With none left to stay, one half.
    """
    counts = _steps(score(docs, model), GRADES)
    rejected, below = sum(n for step, n in counts if step < GRADES // 2), 0
    for step, n in counts:
        if below >= rejected:
            return min(step / GRADES, 0.5)
        below += n
    return 0.5


def passing(docs: DataFrame, model: Model, cut: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``cut`` or more; nulls count as empty texts."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in texts], float).reshape(-1, WIDTH)), dtype=float)

    return docs.where(scored(F.col("text").cast("string")) >= cut)
