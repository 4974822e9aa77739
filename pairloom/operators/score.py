"""Scoring against gold standards: haplotype combinations, painted windows, nearest truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.columns import haplotype_index, sample_of
from pairloom.operators.intervals import agreement
from pairloom.operators.rows import bins


def by_haplotype(ours: DataFrame, gold: DataFrame) -> DataFrame:
    """Agreement for every combination of haplotype numbers of two samples, of either side:
    chrom, sample1, hap1, sample2, hap2 and the lengths and rates. Samples are in order,
    their haplotypes with them."""
    a, b = F.struct(sample_of("hap_a").alias("s"), haplotype_index("hap_a").alias("h")), F.struct(sample_of("hap_b").alias("s"), haplotype_index("hap_b").alias("h"))
    mine = ours.select("chrom", "start_bp", "end_bp", F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x.h is not null and y.h is not null")
    g1, g2 = F.struct(F.col("sample1").alias("s"), F.col("hap1").alias("h")), F.struct(F.col("sample2").alias("s"), F.col("hap2").alias("h"))
    theirs = gold.select("chrom", "start_bp", "end_bp", F.least(g1, g2).alias("x"), F.greatest(g1, g2).alias("y"))
    flat = lambda d: d.select("chrom", "start_bp", "end_bp", F.col("x.s").alias("sample1"), F.col("x.h").alias("hap1"), F.col("y.s").alias("sample2"), F.col("y.h").alias("hap2"))
    return agreement(flat(mine), flat(theirs), ["chrom", "sample1", "hap1", "sample2", "hap2"])


def best_combination(scores: DataFrame) -> DataFrame:
    """Per pair of samples: the combination with the highest Jaccard, the lowest numbers of equal ones."""
    order = F.struct(F.col("jaccard"), -F.col("hap1"), -F.col("hap2"))
    return scores.groupBy("chrom", "sample1", "sample2").agg(F.max_by(F.struct("hap1", "hap2", "jaccard", "precision", "recall"), order).alias("b")).select("chrom", "sample1", "sample2", "b.*")


def painted_windows(segments: DataFrame, keys: list[str], label: str, size: int, order: str = "start_bp") -> DataFrame:
    """One label for each window of the grid that a segment touches; the last segment in
    order wins."""
    rows = segments.withColumn("window", bins(F.col("start_bp"), F.col("end_bp"), size))
    return rows.groupBy(*keys, "window").agg(F.max_by(label, F.struct(order, label)).alias(label))


def nearest_window(ours: DataFrame, truth: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Each of our windows (start_bp, end_bp) with the truth of the grid window whose start is
    nearest to its own, if that is within half a window; ties take the earlier one."""
    at = F.ceil(F.col("start_bp") / size - F.lit(0.5)).cast("long")
    keyed = ours.withColumn("window", at).filter(F.abs(F.col("start_bp") - F.col("window") * size) <= size / 2)
    return keyed.join(truth, [*keys, "window"])


def window_agreement(rows: DataFrame, keys: list[str], ours: str, truth: str) -> DataFrame:
    """Share of windows with equal labels."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg((F.col(ours) == F.col(truth)).cast("double")), 6).alias("concordance"))
