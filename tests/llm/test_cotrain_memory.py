"""The memory that fitting the classifier takes on the driver."""

import tracemalloc

import numpy as np

from demandlens.llm import cotrain


def test_fitting_copies_the_sample_once():
    rng = np.random.default_rng(1)
    x = np.zeros((2_000, cotrain.CONTENT + cotrain.META), dtype=np.float32)
    x[np.arange(2_000)[:, None], rng.integers(0, x.shape[1], (2_000, 200))] = 0.05
    y = np.where(np.arange(2_000) < 1_000, np.arange(2_000) % 2, -1)
    for column in (5, cotrain.CONTENT + 5):
        x[:, column] = 0.8 * (np.arange(2_000) % 2)
    held = cotrain.split(np.arange(2_000), y)
    tracemalloc.start()
    try:
        model = cotrain.cotrain(x[:, :cotrain.CONTENT], x[:, cotrain.CONTENT:], y, held)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model is not None
    assert peak < 0.95 * x.nbytes, peak / x.nbytes
