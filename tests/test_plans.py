import itertools
import math

import numpy as np
import pytest
from generators import mosaic, shared_pairs

from pairloom.kernels import chain, states, timing
from pairloom.kernels import two_state as K
from pairloom.operators.rows import load_pairs
from pairloom.plans.painting import PaintOptions, paint, timing as timing_of
from pairloom.plans.pairs import PairOptions, decode_windows, detect_shared


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start_bp long, end_bp long, group_a string, group_b string, identity double")


def test_golden_shared_segments(spark):
    found = detect_shared(load_pairs(frame(spark, shared_pairs())), PairOptions(min_len_bp=1_000_000)).collect()
    got = sorted((r.hap_a, r.hap_b, r.chrom, r.start_bp, r.end_bp, r.n_windows, f"{r.mean_identity:.6f}", f"{r.mean_posterior:.4f}", f"{r.lod_score:.2f}") for r in found)
    assert got == [
        ("SIM1#1", "SIM2#1", "chr12", 1250000, 3750000, 250, "0.999941", "1.0000", "2280.21"),
        ("SIM1#2", "SIM3#1", "chr12", 500000, 2000000, 150, "0.999948", "1.0000", "1446.78"),
    ]


@pytest.mark.parametrize("options", [{"multi_scale": True}, {"k0_feature": True}, {"emission_context": 2}, {"bridge_gaps": 3}, {"composite": True}, {"distance_transitions": True}, {"adaptive_refinement": True, "adaptive_transitions": True}, {"contrast": True}, {"logit_emissions": True}, {"coverage_feature": True}])
def test_options_find_the_planted_segments(spark, options):
    pairs = load_pairs(frame(spark, shared_pairs())).selectExpr("*", "1000L as a_length", "900L + start_bp div 10000 % 7 as b_length")
    found = detect_shared(pairs, PairOptions(min_len_bp=1_000_000, **options)).collect()
    assert {(r.hap_a, r.hap_b) for r in found} >= {("SIM1#1", "SIM2#1"), ("SIM1#2", "SIM3#1")}


def test_golden_painting(spark):
    pops = spark.createDataFrame([(f"GP{k}", f"GP{k}") for k in range(1, 5)], "population string, haplotype string")
    raw = frame(spark, mosaic()).selectExpr("chrom", "start_bp", "end_bp", "group_a as hap_a", "group_b as hap_b", "identity")
    found = paint(raw, pops, ["CHILD"], PaintOptions(estimate=True)).orderBy("start_bp").collect()
    got = [(r.start_bp, r.end_bp, r.ancestry, r.n_windows, f"{r.mean_similarity:.6f}", f"{r.mean_posterior:.6f}", f"{r.discriminability:.6f}", f"{r.lod_score:.4f}") for r in found]
    assert got == [
        (0, 1250000, "GP1", 125, "0.999939", "0.994153", "0.002185", "36.6176"),
        (1250000, 2500000, "GP2", 125, "0.999944", "0.990735", "0.002197", "35.9432"),
        (2500000, 3750000, "GP3", 125, "0.999947", "0.990497", "0.002233", "37.1139"),
        (3750000, 5000000, "GP4", 125, "0.999947", "0.995475", "0.002210", "36.7521"),
    ]
    assert timing_of(paint(raw, pops, ["CHILD"], PaintOptions(estimate=True))).count() == 4


@pytest.mark.parametrize("options", [{"two_pass": True}, {"transforms": (("center", ()), ("residual", (("factor", 1.2),)), ("persistence", ()))}, {"decoding": "posterior", "entropy_smooth": 2}, {"emission_context": 1, "majority_radius": 2}, {"contrast": True, "consistency_weight": 0.3}, {"emission_model": "mean", "smooth_min_windows": 3}, {"emission_model": "top", "posterior_smooth": True, "smooth_min_windows": 3}, {"emission_model": "median", "label_smooth": 0.05}, {"transition": ("momentum", ())}, {"transition": ("lookahead", (("radius", 2),)), "two_pass": True}])
def test_paint_options_find_the_quarters(spark, options):
    pops = spark.createDataFrame([(f"GP{k}", f"GP{k}") for k in range(1, 5)], "population string, haplotype string")
    raw = frame(spark, mosaic()).selectExpr("chrom", "start_bp", "end_bp", "group_a as hap_a", "group_b as hap_b", "identity")
    found = paint(raw, pops, ["CHILD"], PaintOptions(estimate=True, **options)).collect()
    big = sorted((r.start_bp, r.ancestry) for r in found if r.n_windows > 60)
    assert [a for _, a in big] == ["GP1", "GP2", "GP3", "GP4"] and all(abs(s - k * 1_250_000) <= 50_000 for k, (s, _) in enumerate(big))


def test_recursions_against_all_paths():
    rng = np.random.default_rng(3)
    for k, n in ((2, 6), (3, 5)):
        emit, init = rng.normal(size=(2, n, k)), np.log(rng.dirichlet(np.ones(k), 2))
        trans = np.log(rng.dirichlet(np.ones(k), (2, n - 1, k)))
        lengths = np.array([n, n - 2])
        post, ll = chain.posteriors(emit, init, trans, lengths)
        path = chain.viterbi(emit, init, trans, lengths)
        for g in range(2):
            m = lengths[g]
            score = {p: init[g, p[0]] + sum(emit[g, t, p[t]] for t in range(m)) + sum(trans[g, t, p[t], p[t + 1]] for t in range(m - 1)) for p in itertools.product(range(k), repeat=int(m))}
            total = math.log(sum(map(math.exp, score.values())))
            assert np.isclose(total, ll[g]) and tuple(path[g, :m]) == max(score, key=score.get)
            for t in range(m):
                for s in range(k):
                    assert np.isclose(post[g, t, s], sum(math.exp(v - total) for p, v in score.items() if p[t] == s))


def test_batches_equal_single_sequences():
    rng = np.random.default_rng(5)
    xs = [np.clip(rng.normal(0.998, 0.0004, n), 0.99, 1) for n in (30, 12, 45, 7)]
    ps = [K.robust(K.Params.of(), x, "GENERIC", 10_000) for x in xs]
    together = K.train(ps, xs, "GENERIC", 10_000, 8)
    for p, q, x in zip(ps, together, xs):
        alone = K.train([p], [x], "GENERIC", 10_000, 8)[0]
        assert np.allclose([alone.low.mean, alone.high.std, alone.enter, alone.leave], [q.low.mean, q.high.std, q.enter, q.leave])


def test_refinement_and_bridging():
    s = np.array([0, 0, 1, 1, 0, 0, 1, 0])
    p = np.array([0.1, 0.6, 0.9, 0.15, 0.35, 0.4, 0.9, 0.5])
    assert K.refine(s, p).tolist() == [0, 1, 1, 0, 0, 0, 1, 1]
    assert K.bridge(s, p, 2, 0.3).tolist() == [0, 0, 1, 1, 1, 1, 1, 0]
    assert K.bridge(s, p, 1, 0.3).tolist() == s.tolist()
    assert K.refine_adaptive(np.array([0, 1, 1, 0]), np.array([0.35, 0.9, 0.9, 0.2])).tolist() == [1, 1, 1, 0]
    assert K.run_list(np.array([1, 0, 1, 1])) == [(0, 0), (2, 3)]


def test_smoothing_and_matching():
    assert states.smooth([0, 1, 0, 0, 2, 2, 0], 2).tolist() == [0, 0, 0, 0, 2, 2, 0]
    assert states.smooth([0, 1], 3).tolist() == [0, 1]
    p = np.array([[0.9, 0.1], [0.05, 0.95], [0.9, 0.1], [0.45, 0.55]])
    assert states.posterior_smooth([0, 1, 0, 0], p, 2, 0.6, 0.1).tolist() == [0, 0, 0, 0]
    r = states.match_switches([10, 11, 50], [12, 13, 90], 3)
    assert (r["matched"], r["missed"], r["spurious"]) == (2, 1, 1)
    assert states.correct_short([0, 0, 1, 2, 2], np.array([[0.8, 0.1, 0.1]] * 2 + [[0.2, 0.5, 0.3]] + [[0, 0, 1.0]] * 2), 2).tolist() == [0, 0, 2, 2, 2]


def test_timing_separates_two_pulses():
    rng = np.random.default_rng(0)
    one = 20_000 + rng.exponential(1e6, 400)
    assert timing.pulses(one)["n_pulses"] == 1
    two = 20_000 + np.r_[rng.exponential(1e5, 600), rng.exponential(5e6, 400)]
    r = timing.pulses(two)
    assert r["n_pulses"] >= 2 and r["rejected"] and np.isclose(sum(p["proportion"] for p in r["pulses"]), 1)
    assert timing.pulses(np.array([1.0, 2.0]))["n_pulses"] == 0


def test_short_pairs_give_nothing(spark):
    rows = [("chr1", 1, 10, "A#1", "B#1", 0.999), ("chr1", 11, 20, "A#1", "B#1", 0.999)]
    assert decode_windows(load_pairs(frame(spark, rows))).count() == 0 and detect_shared(load_pairs(frame(spark, []))).count() == 0


def test_registered_queries_train_for_all_rounds(monkeypatch):
    from pairloom import queries
    from pairloom.plans import pairs

    seen = []
    monkeypatch.setattr(queries.V, "similarity", lambda *_: None)
    for name in ("decode_windows", "detect_shared"):
        monkeypatch.setattr(pairs, name, lambda _, o: seen.append(o.rounds))
    queries.ibd_posteriors(None, "")
    queries.ibd_segments(None, "")
    assert seen == [PairOptions().rounds] * 2
