import numpy as np
import pytest

from pairloom.kernels import transitions as T

RNG = np.random.default_rng(2)
K, N = 3, 30
BASE = np.log(np.full((K, K), 0.01) + 0.97 * np.eye(K))
POST = RNG.dirichlet(np.ones(K), N)
STATES = np.repeat([0, 1, 2], 10)
E = np.log(RNG.dirichlet(np.ones(K), N))


@pytest.mark.parametrize("make", [
    lambda: T.adaptive(BASE, POST), lambda: T.boundary_boost(BASE, STATES), lambda: T.cooccurrence(BASE, STATES), lambda: T.confusion(BASE, STATES), lambda: T.momentum(BASE, STATES),
    lambda: T.segment_length(BASE, STATES), lambda: T.lookahead(BASE, E), lambda: T.recency(BASE, POST), lambda: T.disagreement(BASE, E, STATES),
])
def test_rows_sum_to_one(make):
    t = make()
    assert t.shape == (N - 1, K, K) and np.allclose(np.exp(t).sum(2), 1)


def test_directions():
    b = T.boundary_boost(BASE, STATES)
    assert b[9, 0, 1] > b[5, 0, 1]
    assert T.momentum(BASE, STATES)[8, 0, 0] > T.momentum(BASE, STATES)[0, 0, 0]
    assert T.segment_length(BASE, STATES)[0, 0, 0] > T.segment_length(BASE, STATES)[8, 0, 0]
    assert T.run_lengths(np.array([0, 0, 1, 1, 1])).tolist() == [1, 2, 1, 2, 3]
    p = np.exp(T.population_aware(np.array([0.9, 0.91, 0.99]), 0.95, 0.02))
    assert np.allclose(p.sum(1), 1) and p[0, 1] > p[0, 2]
    assert np.allclose(np.exp(T.retrained(BASE, POST)).sum(1), 1)


def test_purity_quality_and_boosts():
    groups = np.array([0, 0, 1])
    sims = np.array([[0.9, 0.8, 0.1], [0.9, 0.8, 0.2], [0.1, 0.7, 0.75]])
    w = T.purity(sims, groups, 2)
    assert w[0] == 1.0 and w[1] == 1.0 and np.allclose(T.purity_weighted(sims, w, 2.0), sims)
    assert T.calibration_boosts(np.array([0, 0, 0, 1]), np.array([0.5, 0.5]))[1] > 0
    q = T.window_quality(E, STATES, np.ones(N))
    assert q.shape == (N,) and (0 <= q).all() and (q <= 1).all()
