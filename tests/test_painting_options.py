"""Every option of the painting changes or keeps the painting as it should."""

import numpy as np
import pytest

from pairloom.operators import emissions as E
from pairloom.operators import genmap as G
from pairloom.operators import panel as P
from pairloom.plans.painting import PaintOptions, cross_validated, identity_floor, painted

NAMES = ["EAST", "WEST"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for w in range(60):
        for hap, pop in (("E#1", 0), ("E#2", 0), ("W#1", 1), ("W#2", 1)):
            own = (w < 30) == (pop == 0)
            rows.append(("chr1", w * 10_000 + 1, (w + 1) * 10_000, hap, "Q#1", float(np.clip((0.995 if own else 0.985) + rng.normal(0, 0.002), 0, 1))))
    pairs = spark.createDataFrame(rows, "chrom string, start_bp long, end_bp long, hap_a string, hap_b string, identity double")
    pops = spark.createDataFrame([("EAST", "E#1"), ("EAST", "E#2"), ("WEST", "W#1"), ("WEST", "W#2")], "population string, haplotype string")
    return pairs.cache(), pops


def states(data, gmap=None, **options):
    pairs, pops = data
    o = PaintOptions(**({"temperature": 0.005, "switch": 0.01} | options))
    rows = painted(pairs, pops, ["Q#1"], NAMES, o, gmap=gmap).orderBy("start_bp").collect()
    assert all(abs(sum(r.posteriors) - 1) < 1e-6 for r in rows)
    return [r.state for r in rows]


TRUTH = [0] * 30 + [1] * 30
OPTIONS = [
    {}, {"sims_context": 2}, {"purity_power": 1.0}, {"normalize": True, "temperature": None}, {"heteroscedastic": True}, {"groups": "EAST;WEST"}, {"haplotype_weight": 0.2},
    {"loo_weight": 0.3}, {"variance_penalty": 1.0}, {"dampen": 1.0}, {"rank_weight": 0.3}, {"pairwise_weight": 0.3}, {"pairwise_weight": 0.3, "blend": "adaptive"},
    {"pairwise_weight": 0.3, "blend": "agreement"}, {"pairwise_weight": 0.3, "blend": "hybrid"}, {"pairwise_weight": 0.3, "blend": "population"},
    {"pairwise_weight": 0.3, "blend": "population_hybrid"}, {"auto_configure": True}, {"spread_boost": True}, {"distance_transitions": True}, {"train_rounds": 3, "dampening": 0.5},
    {"refine_passes": 2}, {"ensemble": 3}, {"sharpen": 0.5}, {"correct_short": 2}, {"decoding": "mpel"}, {"decoding": "posterior"}, {"majority_radius": 2, "majority_decay": 0.3},
]


@pytest.mark.parametrize("options", OPTIONS, ids=lambda o: "-".join(map(str, o)) or "plain")
def test_option_paints_the_truth(data, options):
    got = states(data, **options)
    assert sum(a == b for a, b in zip(got, TRUTH)) >= 55


def test_map_and_bad_names(spark, data):
    assert sum(a == b for a, b in zip(states(data, G.uniform_map(spark, "chr1", 0, 600_000, 1.0)), TRUTH)) >= 55
    with pytest.raises(ValueError):
        states(data, blend="none of these")
    with pytest.raises(ValueError):
        states(data, groups="EAST;SOUTH")


def test_identity_floor(spark):
    seen = lambda xs: spark.createDataFrame([([float(x), 0.5],) for x in xs], "sims array<double>")
    assert identity_floor(seen([0.99] * 5)) == 0.995
    xs = [0.93] * 3 + [0.98 + 0.0002 * k for k in range(40)]
    assert identity_floor(seen(xs)) == pytest.approx(0.98)


def test_scales_and_configuration():
    far, near = {(0, 1): 5.0, (0, 2): 5.0, (1, 2): 0.2}, 100
    agree, disagree = P.agreement_scales(far, 3, near, 1.5, 0.2)
    assert agree[0] > agree[1] and abs(agree[1] - agree[2]) < 0.5 and disagree[1][2] > disagree[0][1]
    assert P.agreement_scales({(0, 1): 1.0}, 2, 5, 1.5, 0.2) == ([1.5, 1.5], [[0.2, 0.2], [0.2, 0.2]]) and P.agreement_scales({}, 1, 100, 1.5, 0.2)[0] == [1.5]
    assert P.configured([], 50) == (0.3, 0) and P.configured([0.05], 4) == (0.3, 0)
    weight, context = P.configured([0.05], 5000)
    assert context == 2 and weight == pytest.approx(0.7)
    assert E.state_temperatures(0.01, [1.0, 1.0]) == [0.01, 0.01] and E.state_temperatures(0.01, [0.0, 0.0]) == [0.01, 0.01]


def test_normalization(spark):
    seen = spark.createDataFrame([([0.9, 0.0],), ([0.9, 0.0],)], "sims array<double>")
    got = {r.population: (r.mean, r.std) for r in P.normalization(seen, NAMES).collect()}
    assert got == {"EAST": (pytest.approx(0.9), 1e-6), "WEST": (0.0, 1e-6)}


def test_coverage_emissions(spark):
    long = spark.createDataFrame([("q", "c", 1, 2, "EAST", "e", 0.9, 0.9), ("q", "c", 1, 2, "WEST", "w", 0.9, 0.4)], "sample string, chrom string, start_bp long, end_bp long, population string, haplotype string, identity double, coverage double")
    r = P.coverage_emissions(long, NAMES).first().covered
    assert r[0] > r[1] and abs(np.exp(r).sum() - 1) < 1e-12


def test_cross_validation(spark):
    windows = spark.createDataFrame([("E#1", 0), ("E#1", 1), ("E#2", 0), ("W#1", 1), ("X#1", 0)], "sample string, state int")
    pops = spark.createDataFrame([("EAST", "E#1"), ("EAST", "E#2"), ("WEST", "W#1")], "population string, haplotype string")
    got = {r.population: (r.windows, r.correct, r.precision) for r in cross_validated(windows, pops, NAMES).collect()}
    assert got["EAST"] == (3, 2, 1.0) and got["overall"][:2] == (3, 2)
