"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linetriage.llm.common import summed_vector
from linetriage.llm.learning import SAMPLE, Marked, labelled_sample, logistic, remainder, sigmoid

BITS = 18  # n-grams are hashed to so many bits
LENGTHS = (3, 4, 5)
LEAST_Z = 6.0  # how many standard errors apart the two labels must use an n-gram
FEATURES = 1024


def ngrams(text: str) -> list[np.ndarray]:
    """Hashes of all n-grams of the lower-cased whole text with a space at both ends, by length."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out, mult = [], np.uint32(0x9E3779B1)
    rolling = codes * mult
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint32(15))) * mult + codes[n - 1 :] * np.uint32(0x85EBCA77)
        if n in LENGTHS:
            out.append(((rolling ^ (rolling >> np.uint32(13))) * np.uint32(0xC2B2AE3D + 2 * n)) >> np.uint32(32 - BITS))
    return out


def present(text: str, wanted: np.ndarray) -> np.ndarray:
    """The hashes in a text, each once, among those for which the boolean table ``wanted`` holds."""
    found = [g[wanted[g]] for g in ngrams(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    offset: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[self.hashes] = True
        weight[self.hashes] = self.weights
        return wanted, weight


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, penalty: float = 1.0) -> Model:
    """Learn from about ``rows`` labelled documents, whose counts and chosen features reach the driver.

    The count of an n-gram under a label is the number of documents that hold it. The log of the ratio of
    both shares scales its feature (1 if present). Only n-grams that the labels use differently by
    ``LEAST_Z`` standard errors enter, at most ``FEATURES``. Without rows of both labels every score is
    the label share, or one half without any label.
    """
    sample = labelled_sample(docs, labels, "toxic", remainder("doc_id", 4) != 2, rows)
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        sums, everything = np.zeros(2 * size + 2, np.uint32), np.ones(size, bool)
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sums[label * size + present(text, everything)] += 1
                sums[2 * size + label] += 1
        yield sums

    sums = summed_vector(sample, count, 2 * size + 2).astype(float)
    clean, toxic = sums[2 * size], sums[2 * size + 1]
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 1)
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(share / (1 - share))))
    q, p = sums[:size], sums[size : 2 * size]
    ratio = np.log(((p + 1) / (toxic + 2)) / ((q + 1) / (clean + 2)))
    both = (p + q + 1) / (clean + toxic + 2)
    z = (p / toxic - q / clean) / np.sqrt(both * (1 - both) * (1 / toxic + 1 / clean) + 1e-12)
    order = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    hashes = np.sort(order[np.abs(z[order]) >= LEAST_Z])
    wanted = np.zeros(size, bool)
    wanted[hashes] = True

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [present(t, wanted).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), batch.column(2)], names=["doc_id", "x", "label"])

    seen = sample.mapInArrow(choose, "doc_id long, x binary, label int").toPandas().sort_values(["doc_id", "label", "x"])
    x = Marked([np.searchsorted(hashes, np.frombuffer(raw, "<u4")) for raw in seen.x], ratio[hashes])
    weights = logistic(x, seen.label.to_numpy().astype(float), np.append(np.full(len(hashes), penalty), 1e-6))
    return Model(hashes.astype(np.uint32), weights[:-1] * ratio[hashes], float(weights[-1]))


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text); predicted is 1 from ``cut`` on.

    A null text counts as empty; empty texts are scored like any other. Repeated rows and null doc_ids
    give a row each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = model.table()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sums = np.array([weight[present(t or "", wanted)].sum() for t in part.column(1).to_pylist()])
                got = sigmoid(sums + model.offset)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(got), pa.array((got >= cut).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))


def passing(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``cut``; nulls count as empty texts.

    A model that had no n-gram to learn from tells no documents apart, so all of them pass.
    """
    if not len(model.hashes):
        return docs

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        wanted, weight = model.table()
        sums = np.array([weight[present(t or "", wanted)].sum() for t in texts], float)
        return pd.Series(sigmoid(sums + model.offset), dtype=float)

    return docs.where(scored(F.col("text").cast("string")) < cut)
