"""Training on the driver keeps its rows once: their values would take twice as much again."""

import tracemalloc

import numpy as np

from lattica.llm import quality


def test_fit_makes_no_second_copy_of_its_rows():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(quality.WIDTH, 2000, replace=False)).astype("<i4") for _ in range(1500)]
    labels = np.arange(1500) % 2
    tracemalloc.start()
    v, _, _ = quality.fit(rows, labels, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert v.any() and peak < 20e6  # the values of all rows alone are 24 MB
