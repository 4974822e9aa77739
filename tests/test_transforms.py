import numpy as np
import pytest

from pairloom.kernels import estimates as S
from pairloom.kernels import transforms as T


@pytest.mark.parametrize("name", T.ORDER)
def test_every_transform_keeps_shape_and_missing_data(name):
    rng = np.random.default_rng(1)
    e = T.log_softmax(rng.normal(size=(40, 4)))
    out = T.apply(e, {name: {}})
    assert out.shape == e.shape and not np.isnan(out).any()
    e[3, 1] = e[7, 2] = -np.inf
    out = T.apply(e, {name: {}})
    assert out.shape == e.shape and not np.isnan(out).any()


def test_order_and_unknown_names():
    e = np.log(np.array([[0.7, 0.2, 0.1], [0.3, 0.3, 0.4]]))
    both = T.apply(e, {"residual": {"factor": 2}, "center": {}})
    assert np.allclose(both, T.residual(T.center(e), 2))
    with pytest.raises(ValueError):
        T.apply(e, {"nothing": {}})


def test_specified_ones_by_hand():
    e = np.array([[0.0, -2.0], [-4.0, -np.inf], [-1.0, -1.0]])
    assert np.allclose(T.center(e)[0], [1, -1]) and T.center(e)[1, 1] == -np.inf
    assert np.allclose(T.smooth_context(np.array([[0.0], [3.0], [6.0]]), 1), [[1.5], [3.0], [4.5]])
    c = T.consistency(e, 1)
    assert np.allclose(c[0], np.log([(2 + 0.5) / 3, 0.5 / 3])) and np.allclose(c[2], np.log([(1.5 + 0.5) / 3, (0.5 + 0.5) / 3]))
    assert np.allclose(T.label_smooth(np.array([[-1.0, -3.0]]), 0.5), [[-0.5 + 0.5 * np.log(0.5), -1.5 + 0.5 * np.log(0.5)]])


def test_estimates():
    s = [0] * 20 + [1] * 20 + [0] * 5 + [2] * 3
    p = S.proportions(s, 4)
    assert np.isclose(p.sum(), 1) and 0 < p[3] < 1e-5
    r = S.switch_rates(s, 4)
    assert r[2] == r[3] == 0.001 and r[1] == 0.05
    t = S.proportional_transitions(np.array([0.5, 0.3, 0.2]), np.array([0.01, 0.02, 0.03]))
    assert np.allclose(t.sum(1), 1) and np.isclose(t[0, 1] / t[0, 2], 1.5) and t[1, 1] == 0.98
    d = S.distance_transitions(np.array([0, 10, 50]), 10, 3, 0.01)
    assert d.shape == (2, 3, 3) and np.allclose(np.exp(d).sum(2), 1) and d[1, 0, 1] > d[0, 0, 1] and not len(S.distance_transitions(np.array([1]), 10, 3, 0.01))
    m = S.modulated_switch(0.01, np.array([0.01, 0.02, 90.0]), np.array([10_000, 10_000, 10_000]))
    assert np.isclose(m[0], 0.01, rtol=1e-3) and m[1] > m[0] and m[2] == 0.5
    assert S.auto_configure(np.ones((5, 3))) == (0.3, 0)
    rng = np.random.default_rng(0)
    w, c = S.auto_configure(rng.normal([0.99, 0.98], 0.01, (6000, 2)))
    assert 0 < w <= 0.95 and 1 <= c <= 15
    assert S.population_scale(0.02, 3) == 0.02 > S.population_scale(0.02, 6) and S.population_scale(0.02, 1) == 0.02
    assert np.isclose(S.panel_scale(0.02, 10), 0.02) and S.panel_scale(0.02, 100) < 0.02 and S.panel_scale(0.02, 1) == 0.02
    b = S.train_transitions(None, np.array([[5.0, 1, 0], [0, 9, 1], [1, 1, 2]]), np.full((3, 3), 1 / 3))
    assert np.allclose(b.sum(1), 1) and (np.diag(b) >= 0.9).all() and (np.diag(b) <= 0.9999).all()
    assert np.allclose(S.train_transitions(None, np.eye(2), np.eye(2), 1.0), np.eye(2))
    x = S.profile_emissions(np.array([[1.0, 1.0], [0.2, 0.9]]), np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert np.allclose(x[0], np.log(0.5)) and x[1, 1] > x[1, 0]
    assert S.majority(np.array([0, 0, 1, 0, 0]), 1).tolist() == [0, 0, 0, 0, 0]
    assert np.allclose(S.entropy_smooth(np.array([[1.0, 0], [0.5, 0.5], [1, 0]]), 1).sum(1), 1)
