"""Running medians and deviations against brute force, and the worked examples."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.operators import kernel

NUMBERS = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6), st.just(float("nan"))), max_size=25)


@settings(max_examples=300, deadline=None)
@given(NUMBERS)
def test_running_is_brute_force(values):
    medians, mads = kernel.running(np.array(values))
    for k in range(len(values) + 1):
        x = np.array([v for v in values[:k] if v == v])
        m = np.median(x) if len(x) else 0.0
        d = np.median(np.abs(x - m)) if len(x) > 1 else 0.0
        assert np.isclose(medians[k], m) and np.isclose(mads[k], d, atol=1e-6)


@settings(max_examples=100, deadline=None)
@given(NUMBERS)
def test_running_variance(values):
    got = kernel.running_variance(np.array(values))
    for k in range(len(values) + 1):
        x = np.array([v for v in values[:k] if v == v])
        assert np.isclose(got[k], x.var() if len(x) else 0.0, rtol=1e-6, atol=1e-3)


def test_draws_of_the_example():
    drawn = np.array([-3.0, -2, -1, 5, 10, 15, 20])
    medians, mads = kernel.running(drawn[::-1])
    assert list(zip(medians[::-1], mads[::-1], strict=True)) == [(5, 7), (7.5, 8), (10, 5), (12.5, 5), (15, 5), (17.5, 2.5), (20, 0), (0, 0)]
    scores = kernel.cut_scores(drawn[:, None], np.ones(1), "mad", "l1")
    assert scores[3] == 3.625 and scores[4] == 3.125 and kernel.best_cut(scores) == 4


def test_ties_go_to_the_last_cut_and_few_draws_to_none():
    assert kernel.best_cut(np.zeros(10)) == 6
    assert kernel.best_cut(np.zeros(6)) is None
    assert np.isinf(kernel.cut_scores(np.ones((8, 1)), np.zeros(1), "mad", "l1")).all()
