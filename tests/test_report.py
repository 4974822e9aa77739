"""Reports on literal cases, and cross validation by folds."""

import numpy as np
import pytest

from pairloom.operators import report
from pairloom.plans.painting import PaintOptions, cross_validate_folds, folds


def rows(spark, ours, truth):
    return spark.createDataFrame([("s", k, k * 10, k * 10 + 10, a, b) for k, (a, b) in enumerate(zip(ours, truth))], "sample string, pos long, start_bp long, end_bp long, ours int, truth int")


def test_concordance(spark):
    r = report.concordance(rows(spark, [0, 0, 0, 1, 1, 1, 0, 0], [0, 0, 1, 1, 1, 1, 1, 0]), ["sample"], "pos", "ours", "truth", 1).first()
    assert (r.n_windows, r.concordance) == (8, 0.75) and (r.n_true_switches, r.n_predicted_switches, r.n_detected, r.n_spurious) == (2, 2, 2, 0)
    assert (r.detection_rate, r.switch_precision, r.mean_distance) == (1.0, 1.0, 1.0) and "75.00 %" in report.concordance_text(r)
    same = report.concordance(rows(spark, [1, 1], [1, 1]), ["sample"], "pos", "ours", "truth").first()
    assert (same.concordance, same.detection_rate, same.n_true_switches) == (1.0, 1.0, 0)


def test_segment_concordance(spark):
    got = report.segment_concordance(rows(spark, [0, 0, 0, 1], [0, 0, 1, 1]), ["sample"], "pos", "ours", "truth", "start_bp", "end_bp").collect()
    by = {r.state: (r.a_bp, r.b_bp, r.ab_bp, r.jaccard, r.f1) for r in got}
    assert by == {0: (30, 20, 20, round(2 / 3, 6), 0.8), 1: (10, 20, 10, 0.5, round(2 / 3, 6))}
    assert report.segment_text(got, ["A", "B"]).startswith("A: Jaccard=0.6667")


def test_grid_starts(spark):
    s = spark.createDataFrame([("c", 5, 12), ("c", 20, 26), ("d", 3, 3)], "chrom string, start_bp long, end_bp long")
    assert sorted((r.chrom, r.start_bp) for r in report.grid_starts(s, ["chrom"], 10).collect()) == [("c", 5), ("c", 15), ("c", 25)]
    assert report.grid_starts(s, ["chrom"], 0).count() == 0


def test_folds_and_cross_validation(spark):
    pops = spark.createDataFrame([("EAST", f"E#{k}") for k in range(3)] + [("WEST", f"W#{k}") for k in range(3)] + [("ONE", "O#1")], "population string, haplotype string")
    dealt = {r.haplotype: r.fold for r in folds(pops, 2).collect()}
    assert dealt == {"E#0": 0, "E#1": 1, "E#2": 0, "W#0": 0, "W#1": 1, "W#2": 0, "O#1": None}
    rng = np.random.default_rng(2)
    haps = [f"E#{k}" for k in range(3)] + [f"W#{k}" for k in range(3)]
    data = [("chr1", w * 10 + 1, w * 10 + 10, a, b, float((0.999 if a[0] == b[0] else 0.98) + rng.normal(0, 0.001))) for w in range(12) for i, a in enumerate(haps) for b in haps[i + 1 :]]
    pairs = spark.createDataFrame(data, "chrom string, start_bp long, end_bp long, hap_a string, hap_b string, identity double")
    two = pops.filter("population <> 'ONE'")
    found = cross_validate_folds(pairs, two, ["EAST", "WEST"], 3, PaintOptions(temperature=0.005, closeness=1.0)).collect()
    by = {r.population: r for r in found}
    assert by["overall"].windows == 72 and by["overall"].accuracy > 0.95 and "overall" in report.validation_text(found)
    assert not report.has_bias(spark.createDataFrame(found))
    with pytest.raises(ValueError):
        cross_validate_folds(pairs, pops.filter("population = 'ONE'"), ["ONE"], 3)
