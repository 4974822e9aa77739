"""Column functions: identifiers, densities, ratios and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sample_of(hap) -> Column:
    """SAMPLE of SAMPLE#HAP#CONTIG."""
    return F.substring_index(_c(hap), "#", 1)


def haplotype_of(name) -> Column:
    """SAMPLE#HAP; a name with fewer fields stays."""
    return F.substring_index(_c(name), "#", 2)


def haplotype_index(hap) -> Column:
    """The second field as a number up to 255, or null."""
    n = F.try_element_at(F.split(_c(hap), "#"), F.lit(2)).try_cast("int")
    return F.when(n.between(0, 255), n)


def strip_coordinates(name) -> Column:
    """The name without a trailing :start-end."""
    return F.regexp_replace(_c(name), r":[0-9-]*-[0-9-]*$", "")


def short_chrom(chrom) -> Column:
    """What follows the last # if that starts with chr, else the name as it is."""
    tail = F.substring_index(_c(chrom), "#", -1)
    return F.when(tail.startswith("chr"), tail).otherwise(_c(chrom))


def coverage_ratio(a, b) -> Column:
    """The shorter length over the longer; 0 if both are 0."""
    return F.when(F.greatest(_c(a), _c(b)) <= 0, F.lit(0.0)).otherwise(F.least(_c(a), _c(b)) / F.greatest(_c(a), _c(b)))


def gaussian_log_pdf(x, mean: float, std: float) -> Column:
    z = (_c(x) - F.lit(float(mean))) / F.lit(float(std))
    return F.lit(-0.5) * z * z - F.lit(math.log(std) + 0.5 * math.log(2 * math.pi))


def gaussian_pdf(x, mean: float, std: float) -> Column:
    return F.exp(gaussian_log_pdf(x, mean, std))


def logit(x, cap: float = 12.0) -> Column:
    """ln(x / (1 - x)) of x within 1e-10 of 0 and 1, capped on both sides."""
    y = F.least(F.lit(1 - 1e-10), F.greatest(F.lit(1e-10), _c(x)))
    return F.least(F.lit(cap), F.greatest(F.lit(-cap), F.ln(y / (1 - y))))


def inv_logit(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def window_lod(x, shared: tuple[float, float], background: tuple[float, float]) -> Column:
    """log10 of the likelihood ratio of the shared against the background state."""
    return (gaussian_log_pdf(x, *shared) - gaussian_log_pdf(x, *background)) / F.lit(math.log(10))


def bernoulli_log_pmf(indicator, p: float) -> Column:
    p = min(max(p, 1e-10), 1 - 1e-10)
    return F.when(_c(indicator) > 0.5, F.lit(math.log(p))).otherwise(F.lit(math.log(1 - p)))


def quality_score(mean_posterior, min_posterior, lod, n) -> Column:
    """0 to 100: 40 x mean posterior + 20 x min/mean + 30 x LOD a window + 10 x n/20, each capped at its weight."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    steady = F.when(_c(mean_posterior) > 0, unit(_c(min_posterior) / _c(mean_posterior))).otherwise(0.0)
    per = F.when(_c(n) > 0, unit(_c(lod) / _c(n))).otherwise(0.0)
    return 40 * unit(_c(mean_posterior)) + 20 * steady + 30 * per + 10 * unit(_c(n) / 20.0)


def overlap_bp(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def f1_score(precision, recall) -> Column:
    total = _c(precision) + _c(recall)
    return F.when(total < 1e-15, F.lit(0.0)).otherwise(2 * _c(precision) * _c(recall) / total)
