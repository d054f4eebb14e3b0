"""The fit of both text classifiers: by blocks of rows, with the weights of the plain formula."""

import tracemalloc

import numpy as np
import pytest

from linetriage.llm import learning


def plain(x, y, penalty, steps=40):
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = learning.sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


@pytest.fixture
def rows():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3 * learning.BLOCK + 7, 6))
    return x, (x[:, 0] + draw.normal(size=len(x)) > 0).astype(float)


def test_weights_are_those_of_the_plain_formula(rows):
    x, y = rows
    penalty = np.full(6, 0.5)
    assert np.allclose(learning.logistic(x, y, penalty), plain(x, y, penalty), atol=1e-5)
    assert np.allclose(learning.products(x, penalty, len(y)), x @ penalty)
    assert learning.products(x[:0], penalty, 0).shape == (0,)


def test_differences_and_marked_rows_are_those_of_whole_tables(rows):
    x, _ = rows
    draw = np.random.default_rng(4)
    left, right = draw.integers(0, len(x), 2000), draw.integers(0, len(x), 2000)
    pairs, ones = learning.Differences(x, left, right), np.ones(2000)
    assert np.allclose(learning.logistic(pairs, ones, np.ones(6)), plain(x[left] - x[right], ones, np.ones(6)), atol=1e-5)
    held, values = draw.random((1500, 6)) < 0.4, np.arange(1.0, 7)
    whole = np.column_stack([held * values, np.ones(1500)])
    marked = learning.Marked([np.flatnonzero(r) for r in held], values)
    assert (marked[10:700] == whole[10:700]).all()
    y = (whole.sum(axis=1) > 9).astype(float)
    assert np.allclose(learning.logistic(marked, y, np.ones(7)), plain(whole, y, np.ones(7)), atol=1e-5)


def test_a_fit_holds_one_block_besides_its_rows():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(12_000, 200)).astype(np.float32)
    y = (x[:, 0] > draw.normal(size=len(x))).astype(float)
    tracemalloc.start()
    learning.logistic(x, y, np.ones(200))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 2
