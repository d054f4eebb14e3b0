"""What both text classifiers share: a bounded labelled sample, and a logistic fit on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 12_000  # labelled rows that a fit reads, about; the bound of what reaches the driver
BLOCK = 512  # rows that a fit holds as double floats at once


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rule: Column, rows: int = SAMPLE) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents for which ``rule`` on doc_id holds.

    Ids are taken by their hash, so the sample is spread over the table and the same on every run. The
    id table is bounded by ``rows`` and so may be broadcast; texts are not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "label in (0, 1) and doc_id is not null").where(rule)
    total = known.count()
    share = min(1.0, rows / total) if total else 1.0
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    if total > rows:
        chosen = F.broadcast(chosen)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(
        chosen, "doc_id").select("doc_id", "text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Differences:
    """Rows ``x[left] - x[right]``, made when a slice is asked for."""

    x: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def __getitem__(self, rows: slice) -> np.ndarray:
        return self.x[self.left[rows]].astype(float) - self.x[self.right[rows]]


@dataclass(frozen=True)
class Marked:
    """Rows that hold ``values[c]`` in their columns c, and 1 in a last column; made when a slice is asked for."""

    columns: list[np.ndarray]
    values: np.ndarray

    def __getitem__(self, rows: slice) -> np.ndarray:
        some = self.columns[rows]
        out = np.zeros((len(some), len(self.values) + 1))
        out[:, -1] = 1
        for row, columns in zip(out, some):
            row[columns] = self.values[columns]
        return out


def products(x: np.ndarray | Differences | Marked, w: np.ndarray, rows: int) -> np.ndarray:
    """``x @ w`` by blocks of rows."""
    return np.concatenate([np.empty(0), *(np.asarray(x[at : at + BLOCK], float) @ w for at in range(0, rows, BLOCK))])


def logistic(x: np.ndarray | Differences | Marked, y: np.ndarray, penalty: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of least logistic loss plus half the penalised squares, by damped Newton steps.

    ``y`` holds targets from 0 to 1. Sums go over blocks of rows, so besides ``x`` only one block is held.
    Raises if the gradient has not vanished at the end.
    """
    w = np.zeros(len(penalty))

    def loss(v, z):
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * v * v).sum())

    z = np.zeros(len(y))
    now = loss(w, z)
    for _ in range(steps):
        p = sigmoid(z)
        slope, bend = penalty * w, np.diag(penalty + 1e-9)
        for at in range(0, len(y), BLOCK):
            rows = slice(at, at + BLOCK)
            part = np.asarray(x[rows], float)
            slope += part.T @ (p[rows] - y[rows])
            bend += (part * (p[rows] * (1 - p[rows]))[:, None]).T @ part
        if np.abs(slope).max() < 1e-6 * max(1, len(y)):
            return w
        step = np.linalg.solve(bend, slope)
        along = products(x, step, len(y))
        size = 1.0
        while (then := loss(w - size * step, z - size * along)) > now and size > 1e-6:
            size /= 2
        w, z, now = w - size * step, z - size * along, min(now, then)
    raise RuntimeError("the logistic fit has not converged")


def calibration(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores chances of label 1."""
    x = np.column_stack([scores, np.ones(len(scores))])
    slope, offset = logistic(x, y.astype(float), np.array([1e-3, 1e-3]))
    return float(slope), float(offset)
