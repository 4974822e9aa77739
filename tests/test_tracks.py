"""Runs over grids with missing windows, their merging, and boundaries, on literal cases."""

import pytest

from pairloom.operators import identity9
from pairloom.operators import islands as L
from pairloom.operators import panel as P
from pairloom.operators import tracks as T

WINDOW = 1000


def windows(spark, values):
    """values: identity or None for a missing window, by place."""
    rows = [("p", k, k * WINDOW + 1, (k + 1) * WINDOW, float(v)) for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "p string, idx long, start_bp long, end_bp long, identity double")


def runs(spark, values, **options):
    o = {"min_identity": 0.9, "max_gap": 1, "min_windows": 2, "min_len_bp": 0} | options
    found = T.tolerant_runs(windows(spark, values), ["p"], len(values), WINDOW, **o)
    return sorted((r.start_idx, r.end_idx, r.n_called) for r in found.collect())


@pytest.mark.parametrize(
    "values,want",
    [
        ([1, 1, 1], [(0, 2, 3)]),
        ([1, 1, 0.5, 1, 1], [(0, 1, 2), (3, 4, 2)]),
        ([1, None, 1, 1], [(0, 3, 3)]),
        # A missing window at the end belongs to the run.
        ([1, 1, None, 0.5], [(0, 2, 2)]),
        ([1, 1, None], [(0, 2, 2)]),
        # The second missing window is one too many, wherever it stands, and ends the run before it.
        ([1, 1, None, 1, None, 1, 1], [(0, 3, 3), (5, 6, 2)]),
        ([1, 1, None, None, 1, 1], [(0, 2, 2), (4, 5, 2)]),
        ([1, 1, None, None], [(0, 2, 2)]),
        ([0.5, None, 1, 1], [(2, 3, 2)]),
        ([1, 0.5, 1], []),
        ([0.5, 0.4], []),
    ],
)
def test_tolerant_runs(spark, values, want):
    assert runs(spark, values) == want


def test_tolerance_length_and_statistics(spark):
    assert runs(spark, [1, 0.85, 1], drop=0.1) == [(0, 2, 3)]
    assert runs(spark, [1, 1, 1], min_len_bp=3001) == [] and runs(spark, [1, 1, 1], min_len_bp=3000) == [(0, 2, 3)]
    r = T.tolerant_runs(windows(spark, [0.95, None, 1.0, None]), ["p"], 4, WINDOW, 0.9, 2, 1, 0).first()
    assert (r.start_bp, r.end_bp, r.n_windows, r.min_identity) == (1, 4000, 4, 0.95) and abs(r.mean_identity - 0.975) < 1e-12


def test_merge_overlapping(spark):
    rows = [("p", 0, 9, 0, 10, 10, 10.0, 0.9), ("p", 5, 14, 5, 15, 10, 20.0, 0.8), ("p", 20, 21, 20, 22, 2, 2.0, 1.0), ("q", 0, 9, 0, 10, 10, 10.0, 0.9)]
    df = spark.createDataFrame(rows, "p string, start_idx long, end_idx long, start_bp long, end_bp long, n_called long, identity_sum double, min_identity double")
    got = sorted((r.p, r.start_idx, r.end_idx, r.n_windows, r.n_called, r.identity_sum, r.min_identity) for r in T.merge_overlapping(df, ["p"]).collect())
    assert got == [("p", 0, 14, 15, 15, 20.0, 0.8), ("p", 20, 21, 2, 2, 2.0, 1.0), ("q", 0, 9, 10, 10, 10.0, 0.9)]


def test_identity_classes_by_chromosome(spark):
    haps = ("A#1", "A#2", "B#1", "B#2")
    schema = "chrom string, start_bp long, end_bp long, hap_a string, hap_b string"
    # The same window on two chromosomes is two loci: united, they would be of another class.
    rows = [("chr1", 1, 10, "A#1", "A#2"), ("chr2", 1, 10, "B#1", "B#2"), ("chr1", 11, 20, "A#1", "B#1"), ("chr1", 21, 30, "A#1", "X#1")]
    got = {r.delta: (r.n, r.proportion) for r in identity9.identity_classes(spark.createDataFrame(rows, schema), haps).collect()}
    assert got == {4: (1, round(1 / 3, 6)), 6: (1, round(1 / 3, 6)), 8: (1, round(1 / 3, 6))}
    alone = identity9.identity_classes(spark.createDataFrame(rows[3:], schema), haps).collect()
    assert [(r.delta, r.n, r.proportion) for r in alone] == [(9, 1, 1.0)]
    assert not identity9.identity_classes(spark.createDataFrame([], schema), haps).collect()
    with pytest.raises(ValueError):
        identity9.identity_classes(spark.createDataFrame(rows, schema), ("A#1", "A#1", "B#1", "B#2"))
    with pytest.raises(Exception, match="ends before"):
        identity9.identity_classes(spark.createDataFrame([("chr1", 10, 1, "A#1", "A#2")], schema), haps).collect()


def test_refined_boundaries(spark):
    rows = spark.createDataFrame([("s", k, 100.0 * k, p) for k, p in enumerate([0.1, 0.4, 0.9, 0.8, 0.3])], "k string, i long, c double, p double")
    segments = spark.createDataFrame([("s", 2, 3, 200, 300), ("s", 0, 0, 0, 0)], "k string, first_pos long, last_pos long, start_bp long, end_bp long")
    got = {r.first_pos: (r.start_bp, r.end_bp) for r in L.refined_boundaries(segments, rows, ["k"], "i", "p", "c").collect()}
    assert got[2] == (120.0, 360.0) and got[0] == (0.0, 0.0)


def test_gold_segments(spark):
    gold = spark.createDataFrame([("a", "b", "c1", 3.0), ("b", "a", "c1", 5.0), ("a", "c", "c2", 9.0)], "sample1 string, sample2 string, chrom string, lod double")
    assert P.segments_in(gold, pair=("b", "a")).count() == 2 and P.segments_in(gold, chrom="c2").count() == 1 and P.segments_in(gold, min_lod=5.0).count() == 2
    assert sorted(map(tuple, P.unique_pairs(gold).collect())) == [("a", "b"), ("a", "c")]


def test_posterior_std(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.7)], "s string, posterior double")
    got = {r.s: r.posterior_std for r in T.posterior_std(rows, ["s"]).collect()}
    assert abs(got["a"] - 0.02**0.5) < 1e-12 and got["b"] == 0
