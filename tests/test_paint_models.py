import numpy as np
import pytest

from pairloom.kernels import paint_models as M

G = np.array([0, 0, 1, 1])
S = np.array([[0.9, 0.8, 0.7, 0.0], [0.0, 0.0, 0.6, 0.5], [0.95, 0.8, 0.7, 0.6]])


def test_aggregates_and_softmax():
    assert np.allclose(M.aggregate(S, G, 2), [[0.9, 0.7], [0, 0.6], [0.95, 0.7]])
    assert np.allclose(M.aggregate(S, G, 2, "mean")[2], [0.875, 0.65]) and np.allclose(M.aggregate(S, G, 2, "median")[0], [0.85, 0.7])
    assert np.allclose(M.aggregate(S, G, 2, "top", 1)[2], [0.95, 0.7]) and np.allclose(M.aggregate(S, G, 2, "top", 2, 0.5)[2, 0], (0.95 + 0.4) / 1.5)
    e = M.softmax_emissions(M.aggregate(S, G, 2), 0.1)
    assert np.allclose(np.exp(e[0]).sum(), 1) and e[1, 0] == -np.inf and e[1, 1] == 0


def test_raw_smoothing_and_bonus():
    assert np.allclose(M.smooth_sims(S, 1)[:, 0], [0.9, 0.0, 0.95]) and np.allclose(M.smooth_sims(S, 1)[0, 2], 0.65)
    b = M.haplotype_bonus(S, G, 2, 1, 0.5, 0.1)
    assert np.allclose(b, 0)
    b = M.haplotype_bonus(S[[0, 2, 0]], G, 2, 1, 0.5, 0.1)
    assert np.allclose(b[:, 0], 0.05) and np.allclose(b[:, 1], 0)


def test_rank_groups_and_pairs():
    r = M.rank_emissions(S, G, 2)
    assert r[0, 0] > r[0, 1] and r[1, 1] > r[1, 0]
    h = M.hierarchical_emissions(np.array([[0.9, 0.8, 0.5]]), [[0, 1], [2]], 0.1)
    assert np.allclose(np.exp(h).sum(), 1) and h[0].argmax() == 0
    assert M.parse_groups("A,B;C", ["A", "B", "C"]) == [[0, 1], [2]]
    with pytest.raises(ValueError):
        M.parse_groups("A;B", ["A", "B", "C"])
    assert M.detect_groups(np.array([0.5, 0.501, 0.9]), 0.01) == [[0, 1], [2]] and M.detect_groups(np.array([0.5, 0.5, 0.5]), 0.01) == [[0], [1], [2]]
    rng = np.random.default_rng(0)
    v = rng.normal([0.95, 0.9, 0.9], 0.01, (50, 3))
    p = M.pairwise_emissions(v)
    assert np.allclose(np.exp(p).sum(1), 1) and (p.argmax(1) == 0).mean() > 0.9


def test_blends():
    a, b = np.array([[-1.0, -2.0], [-1.0, -np.inf]]), np.array([[-2.0, -1.0], [-3.0, -4.0]])
    assert np.allclose(M.blend(a, b, 0.5), [[-1.5, -1.5], [-2.0, -4.0]])
    out = M.blend_per_population(a, b, 0.4, np.array([2.0, 1.0]), np.array([[0, 0.5], [0.25, 0]]))
    assert np.allclose(out[0], [0.8 * -1 + 0.2 * -2, 0.8 * -2 + 0.2 * -1]) and np.allclose(out[1], [0.2 * -1 + 0.8 * -3, -4.0])
    assert M.positive_median(np.array([0.0, 3, 1, 2])) == 2 and M.positive_median(np.zeros(3)) == 1


def test_floor_ensemble_copying_merge():
    assert M.identity_floor(np.ones(5)) == 0.995 and M.identity_floor(np.zeros(30)) == 0.9 and M.identity_floor(np.r_[np.full(3, 0.5), np.full(40, 0.99)]) >= 0.9
    v = np.vstack([np.tile([0.95, 0.9], (30, 1)), np.tile([0.9, 0.95], (30, 1))])
    post = M.ensemble(v, 0.01, 0.01, 3)
    assert np.allclose(post.sum(1), 1) and (post.argmax(1) == np.repeat([0, 1], 30)).all() and not len(M.ensemble(v, 0.01, 0.01, 0))
    assert np.allclose(M.ensemble(v, 0.01, 0.01, 3, 1.0), M.ensemble(v, 0.01, 0.01, 1))
    sims = np.vstack([np.tile([0.99, 0.9, 0.8, 0.8], (20, 1)), np.tile([0.8, 0.8, 0.99, 0.9], (20, 1))])
    sims[10] = [0.8, 0.8, 0.99, 0.9]
    path, post = M.copying(sims, G, 2, 0.01, 0.1, 0.05, 0.5)
    assert path.tolist() == [0] * 20 + [1] * 20 and np.allclose(post.sum(1), 1)
