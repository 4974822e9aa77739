"""Genetic maps against plain Python, and both models along a map."""

import math
import time

import numpy as np
import pytest

from pairloom.kernels import chain
from pairloom.kernels import two_state as K
from pairloom.operators import genmap as G
from pairloom.plans.painting import step_matrices
from pairloom.plans.pairs import PairOptions, decode_windows


def at(entries, x):
    """Linear between entries, extrapolated with the first and last rate."""
    if len(entries) == 1:
        return entries[0][1]
    i = max([k for k, (b, _) in enumerate(entries) if b <= x], default=0)
    (b0, c0), (b1, c1) = (entries[i], entries[i + 1]) if i + 1 < len(entries) else (entries[i - 1], entries[i])
    anchor = entries[i]
    return anchor[1] + ((c1 - c0) / (b1 - b0) if b1 > b0 else 0.0) * (x - anchor[0])


MAPS = {"1": [(100, 0.0), (1100, 1.0), (2100, 5.0)], "2": [(50, 3.0)], "3": [(10, 1.0), (10, 2.0), (20, 4.0)]}


def test_interpolation(spark):
    gmap = spark.createDataFrame([(c, b, m) for c, es in MAPS.items() for b, m in es], "chrom string, bp long, cm double")
    asked = [(c, x) for c in (*MAPS, "4") for x in (0, 15, 100, 600, 1100, 1600, 2100, 3100, 3100)]
    got = G.interpolate(spark.createDataFrame(asked, "chrom string, pos long"), gmap).collect()
    assert len(got) == len(asked)
    for r in got:
        if r.chrom == "4":
            assert r.cm_at is None
        elif not (r.chrom == "3" and r.pos < 10):
            assert abs(r.cm_at - at(MAPS[r.chrom], r.pos)) < 1e-9, r


def test_interpolation_over_many_bins(spark):
    size = 1 << G.BIN_BITS
    entries = {"1": [(-5 * size, 0.5), (-size - 3, 1.0), (size, 2.0), (size + 7, 2.5), (3 * size - 1, 3.0), (40 * size, 9.0)], "2": [(9 * size, 3.0)]}
    gmap = spark.createDataFrame([(c, b, m) for c, es in entries.items() for b, m in es], "chrom string, bp long, cm double")
    places = sorted({k * size + d for k in (-9, -5, -2, -1, 0, 1, 2, 3, 20, 39, 40, 41, 300) for d in (0, 1, 7, size // 2, size - 1)})
    asked = [(c, x) for c in (*entries, "4", None) for x in (*places, None)]
    got = G.interpolate(spark.createDataFrame(asked, "chrom string, pos long"), gmap).collect()
    assert len(got) == len(asked)
    for r in got:
        if r.chrom in entries and r.pos is not None:
            assert abs(r.cm_at - at(entries[r.chrom], r.pos)) < 1e-9, r
        else:
            assert r.cm_at is None, r


def test_interpolation_takes_linear_time(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("'1' as chrom", "id * 400 as pos")
    gmap = G.uniform_map(spark, "1", 0, 1_000_000, 1.5)
    began = time.monotonic()
    off = G.interpolate(rows, gmap).filter("abs(cm_at - pos * 1.5e-6) < 1e-6").count()
    assert off == n and time.monotonic() - began < 60


def test_summary_and_uniform(spark):
    s = G.summary(G.uniform_map(spark, "1", 0, 2_000_000, 1.5)).first()
    assert (s.entries, s.length_cm, s.cm_per_mb) == (2, 3.0, 1.5)


@pytest.mark.parametrize("base,cm,bp", [(0.01, 0.01, 10_000), (0.01, 50.0, 10_000), (1e-8, 0.01, 10_000), (0.01, 0.0, 0), (0.0, 1.0, 10_000)])
def test_modulated_switch(spark, base, cm, bp):
    r = spark.createDataFrame([(cm, bp)], "step_cm double, step_bp long").select(G.modulated_switch(base).alias("s")).first().s
    nominal = 0.5 * (1 - math.exp(-2 * bp / 1e8))
    want = base * 0.5 * (1 - math.exp(-2 * cm / 100)) / nominal if nominal > 0 else base
    assert abs(r - min(max(want, 1e-6), 0.5)) < 1e-12


def test_map_transitions():
    p = K.Params.of("GENERIC", 50, 1e-4, 10_000)
    mid = np.array([5_000, 15_000, 35_000, 35_000])
    cm, nxt = mid / 1e6, (mid + 10_000) / 1e6
    t = np.exp(K.map_transitions(p, mid, cm, nxt, 10_000))
    assert np.allclose(t.sum(2), 1)
    assert abs(t[0, 0, 1] - p.enter) < 1e-12  # one window of a uniform map
    assert abs(t[1, 0, 1] - (1 - (1 - p.enter) ** 2)) < 1e-12
    r = 0.5 * (1 - math.exp(-2 * 0.01 / 100))
    assert abs(t[0, 1, 0] - (1 - (1 - p.leave) ** (1 + r))) < 1e-12
    assert abs(t[2, 0, 1] - p.enter) < 1e-12  # no distance: as it is
    flat = np.exp(K.map_transitions(p, mid, np.full(4, np.nan), np.full(4, np.nan), 10_000))
    assert np.allclose(flat[:, 0, 1], p.enter)


def test_training_with_steps_is_plain_training_for_equal_steps():
    rng = np.random.default_rng(5)
    x = [np.r_[rng.normal(0.9985, 0.001, 60), rng.normal(0.9997, 0.0005, 60)].clip(0.99, 1)]
    p = [K.Params.of("GENERIC", 50, 1e-3, 10_000)]
    plain = K.train(p, x, "GENERIC", 10_000, 5)
    steps = K.train(p, x, "GENERIC", 10_000, 5, step_of=lambda k, q: np.broadcast_to(q.log_trans(), (len(x[k]) - 1, 2, 2)))
    assert np.allclose([plain[0].enter, plain[0].leave, plain[0].low.mean], [steps[0].enter, steps[0].leave, steps[0].low.mean])


def test_simple_emissions():
    p = K.simple(K.Params.of(), np.array([0.5, 0.6, 0.55, 0.45, 0.999, 0.998, 0.9995]))
    assert p.low.mean < 0.7 and p.high.mean > 0.99 and p.low.std >= 0.01 and p.high.std >= 0.001
    assert K.simple(K.Params.of(), np.ones(5)) == K.Params.of() and K.simple(K.Params.of(), np.array([0.1, 0.9])) == K.Params.of()


def test_k_states_follow_the_map():
    e = np.log(np.where(np.arange(20)[:, None] // 10 == np.arange(2), 0.6, 0.4))
    even = np.exp(step_matrices(np.full(19, 0.01), 2))
    assert np.allclose(even.sum(2), 1) and np.allclose(even[:, 0, 0], 0.99)
    hot = np.full(19, 1e-6)
    hot[9] = 0.5
    path = lambda s: chain.viterbi(e[None], np.full((1, 2), -math.log(2)), step_matrices(s, 2)[None], np.array([20]))[0].tolist()
    assert path(hot) == [0] * 10 + [1] * 10 and len(set(path(np.full(19, 1e-6)))) == 1


def test_pairs_along_a_map(spark):
    rng = np.random.default_rng(1)
    ident = np.r_[rng.normal(0.9985, 0.001, 40), rng.normal(0.9997, 0.0004, 40), rng.normal(0.9985, 0.001, 40)].clip(0.99, 1)
    rows = [("chr1", k * 10_000 + 1, (k + 1) * 10_000, "A#1", "B#1", float(v)) for k, v in enumerate(ident)]
    pairs = spark.createDataFrame(rows, "chrom string, start_bp long, end_bp long, hap_a string, hap_b string, identity double")
    o = PairOptions(enter=1e-3)
    plain = [r.state for r in decode_windows(pairs, o).orderBy("idx").collect()]
    mapped = [r.state for r in decode_windows(pairs, o, gmap=G.uniform_map(spark, "chr1", 0, 2_000_000, 1.0)).orderBy("idx").collect()]
    assert sum(a != b for a, b in zip(plain, mapped)) <= 6
    assert len(decode_windows(pairs, PairOptions(trained_steps=True), gmap=G.uniform_map(spark, "chr1", 0, 2_000_000, 1.0)).collect()) == 120
