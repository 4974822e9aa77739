"""Emissions of the K-state model as array columns: one log emission for each population.

-inf means no data. Everything here is an expression on rows, so it stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = float("-inf")


def _finite(x: Column) -> Column:
    return (x > F.lit(NONE)) & ~F.isnan(x) & (x < F.lit(float("inf")))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def pivot(long: DataFrame, names: list[str], model: str = "max", top: int = 2) -> DataFrame:
    """(sample, chrom, start_bp, end_bp, population, identity) -> sims array<double> in the
    order of names: max, mean, median or mean of the top similarities; 0 without data."""
    value = F.when(F.col("identity") > 0, F.col("identity"))
    how = {
        "max": lambda: F.max(value), "mean": lambda: F.avg(value), "median": lambda: F.median(value),
        "top": lambda: _mean(F.slice(F.sort_array(F.collect_list(value), asc=False), 1, top)),
    }[model]()
    per = long.groupBy("sample", "chrom", "start_bp", "end_bp", "population").agg(how.alias("sim"))
    cells = [F.coalesce(F.max(F.when(F.col("population") == n, F.col("sim"))), F.lit(0.0)) for n in names]
    return per.groupBy("sample", "chrom", "start_bp", "end_bp").agg(F.array(*cells).alias("sims"))


def log_softmax(sims: Column, temperature: float | Column) -> Column:
    """log-softmax of sims / temperature over entries above 0; a single one has 0."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(sims)
    total = F.aggregate(sims, F.lit(0.0), lambda s, x: s + F.when(x > 0, F.exp((x - top) / t)).otherwise(0.0))
    return F.transform(sims, lambda x: F.when(x > 0, (x - top) / t - F.ln(total)).otherwise(F.lit(NONE)))


def contrast(e: Column) -> Column:
    """Less the mean of the finite entries."""
    m = _mean(F.filter(e, _finite))
    return F.transform(e, lambda x: F.when(_finite(x), x - m).otherwise(x))


def argmax(e: Column) -> Column:
    """Index of the highest entry, the last of equal ones."""
    n = F.size(e)
    return n - F.array_position(F.reverse(e), F.array_max(e)).cast("int")


def margin(e: Column) -> Column:
    """Highest less second highest finite entry; 0 with fewer than two."""
    s = F.sort_array(F.filter(e, _finite), asc=False)
    return F.when(F.size(s) >= 2, F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2))).otherwise(0.0)


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """(1 - w) a + w b; where one is not finite, the other."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.zip_with(a, b, lambda x, y: F.when(_finite(x) & _finite(y), (1 - w) * x + w * y).when(_finite(x), x).otherwise(y))


def _capped(w: Column) -> Column:
    return F.least(F.lit(0.95), F.greatest(F.lit(0.0), w))


def blend_agreement(a: Column, b: Column, weight: float, agree: float = 1.5, disagree: float = 0.2) -> Column:
    """Blend with w x agree where both have the same best population, else w x disagree."""
    return blend(a, b, _capped(weight * F.when(argmax(a) == argmax(b), agree).otherwise(disagree)))


def blend_adaptive(a: Column, b: Column, weight: float, median_margin: Column) -> Column:
    """Blend with w scaled by the second model's margin over the median one, within .1 and 2.5."""
    scale = F.when(median_margin > 0, F.least(F.lit(2.5), F.greatest(F.lit(0.1), margin(b) / median_margin))).otherwise(1.0)
    return blend(a, b, F.least(F.lit(0.95), weight * scale))


def blend_hybrid(a: Column, b: Column, weight: float, median_margin: Column, agree: float = 1.5, disagree: float = 0.2, low: float = 0.2, high: float = 3.0) -> Column:
    """On agreement w x agree x clamp(margin / median, low, high), else w x disagree."""
    unit = F.when(median_margin > 0, median_margin).otherwise(1.0)
    scale = F.least(F.lit(high), F.greatest(F.lit(low), margin(b) / unit))
    return blend(a, b, _capped(weight * F.when(argmax(a) == argmax(b), agree * scale).otherwise(disagree)))


def upper_median(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The positive values' element at index n div 2 per group, 1 without any."""
    ranked = rows.select(*keys, value.alias("_v")).filter("_v > 0")
    w = Window.partitionBy(*keys)
    at = ranked.withColumn("_r", F.row_number().over(w.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).filter("_r = _n div 2")
    return at.select(*keys, F.col("_v").alias("median_margin"))


def blend_looked_up(a: Column, b: Column, weight: float, agree: list[float], disagree: list[list[float]], median_margin: Column | None = None, low: float = 0.2, high: float = 3.0) -> Column:
    """Blend whose scale is that of the best population where both models agree, and of the
    pair of best ones where they differ; with a median margin, as in the hybrid blend."""
    i, j = argmax(a), argmax(b)
    same = F.get(F.array(*map(F.lit, agree)), i)
    other = F.get(F.get(F.array(*[F.array(*map(F.lit, r)) for r in disagree]), i), j)
    if median_margin is not None:
        same = same * F.least(F.lit(high), F.greatest(F.lit(low), margin(b) / F.when(median_margin > 0, median_margin).otherwise(1.0)))
    return blend(a, b, _capped(weight * F.when(i == j, same).otherwise(other)))


def pairwise(rows: DataFrame, keys: list[str], sims: str, k: int) -> DataFrame:
    """pairwise: each population's mean log odds against every other (Bradley-Terry), with a
    temperature for each pair, the deviation of their difference over the sequence; -inf
    where there is no data."""
    w = Window.partitionBy(*keys)
    s = [F.col(sims)[i] for i in range(k)]
    diff = {(i, j): F.when((s[i] > 0) & (s[j] > 0), s[i] - s[j]).otherwise(0.0) for i in range(k) for j in range(i + 1, k)}
    out = rows.select("*", *[F.greatest(F.stddev_pop(d).over(w), F.lit(1e-6)).alias(f"_t{i}_{j}") for (i, j), d in diff.items()])
    log_odds = lambda i, j: -F.log1p(F.exp(-(diff[min(i, j), max(i, j)] * (1 if i < j else -1)) / F.col(f"_t{min(i, j)}_{max(i, j)}")))
    scores = [sum((log_odds(i, j) for j in range(k) if j != i), F.lit(0.0)) / max(1, k - 1) for i in range(k)]
    top = F.greatest(*scores) if k > 1 else scores[0]
    total = F.ln(sum((F.exp(x - top) for x in scores), F.lit(0.0)))
    found = F.array(*[F.when(s[i] > 0, scores[i] - top - total).otherwise(F.lit(NONE)) for i in range(k)])
    return out.withColumn("pairwise", found).drop(*[f"_t{i}_{j}" for i, j in diff])


def softmax_by_state(sims: Column, temperatures: list[float]) -> Column:
    """log-softmax over entries above 0, each divided by its own temperature."""
    scaled = F.zip_with(sims, F.array(*map(F.lit, temperatures)), lambda x, t: F.when(x > 0, x / t).otherwise(F.lit(NONE)))
    return normalized(scaled)


def normalized(e: Column) -> Column:
    """Less the log of the sum of the exponentials; -inf stays."""
    top = F.array_max(F.filter(e, _finite))
    total = F.aggregate(F.filter(e, _finite), F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(e, lambda x: F.when(_finite(x), x - top - F.ln(total)).otherwise(F.lit(NONE)))


def state_temperatures(base: float, deviations: list[float]) -> list[float]:
    """A temperature for each population: the base times its deviation over the mean one,
    within a half and twice the base. (Known from one sentence; inferred.)"""
    mean = sum(deviations) / len(deviations)
    return [base * min(2.0, max(0.5, d / mean if mean > 0 else 1.0)) for d in deviations]


def hierarchical(sims: Column, parts: list[list[int]], temperature: float, weight: float = 0.5) -> Column:
    """A softmax over groups of populations, by their best, and one within each group, blended."""
    best = F.array(*[F.greatest(*[F.get(sims, F.lit(i)) for i in p]) if len(p) > 1 else F.get(sims, F.lit(p[0])) for p in parts])
    group = log_softmax(best, temperature)
    inner = [log_softmax(F.array(*[F.get(sims, F.lit(i)) for i in p]), temperature) for p in parts]
    at = {i: (g, n) for g, p in enumerate(parts) for n, i in enumerate(p)}
    cells = []
    for i in range(sum(map(len, parts))):
        g, n = at[i]
        cells.append(F.when(F.get(sims, F.lit(i)) > 0, weight * F.get(group, F.lit(g)) + (1 - weight) * F.get(inner[g], F.lit(n))).otherwise(F.lit(NONE)))
    return normalized(F.array(*cells))


def z_scores(sims: Column, means: list[float], stds: list[float]) -> Column:
    """Standardised similarities; null where there is no data."""
    return F.zip_with(F.zip_with(sims, F.array(*map(F.lit, means)), lambda x, m: F.when(x > 0, x - m)), F.array(*map(F.lit, stds)), lambda x, s: x / s)


def softmax_of(z: Column, temperature: float) -> Column:
    """log-softmax over the entries that are not null."""
    return normalized(F.transform(z, lambda x: F.coalesce(x / temperature, F.lit(NONE))))


def dampen(rows: DataFrame, keys: list[str], e: str, scale: float) -> DataFrame:
    """dampened: emissions drawn to uniform by how far their margin is below scale x the
    sequence's median margin. One state is left alone. (Inferred from tests of its order.)"""
    m = margin(F.col(e))
    median = F.median("_m").over(Window.partitionBy(*keys))
    out = rows.withColumn("_m", m).withColumn("_f", F.when(median * scale > 0, F.least(F.lit(1.0), F.col("_m") / (median * scale))).otherwise(F.lit(0.0)))
    even = F.ln(1.0 / F.size(e))
    drawn = F.transform(e, lambda x: F.when(_finite(x), F.col("_f") * x + (1 - F.col("_f")) * even).otherwise(x))
    return out.withColumn("dampened", F.when(F.size(e) > 1, drawn).otherwise(F.col(e))).drop("_m", "_f")


def penalised(e: Column, variance: Column, weight: float) -> Column:
    """e - weight x variance."""
    return F.zip_with(e, variance, lambda x, v: x - weight * v)


def consistency(rows: DataFrame, keys: list[str], order: str, sims: str, k: int, context: int) -> DataFrame:
    """consistency: ln((wins + 0.5) / (windows + 1)) of each population over the windows up
    to `context` away; tied populations share a win."""
    best = F.array_max(F.col(sims))
    ties = F.size(F.filter(F.col(sims), lambda x: (x == best) & (x > 0)))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-context, context)
    n = F.count(F.lit(1)).over(w)
    out = rows.withColumn("_ties", ties).withColumn("_best", best)
    wins = [F.sum(F.when((F.col(sims)[i] == F.col("_best")) & (F.col("_best") > 0), 1.0 / F.col("_ties")).otherwise(0.0)).over(w) for i in range(k)]
    return out.withColumn("consistency", F.array(*[F.ln((x + 0.5) / (n + 1)) for x in wins])).drop("_ties", "_best")


def smooth_arrays(rows: DataFrame, keys: list[str], order: str, e: str, k: int, context: int) -> DataFrame:
    """Centred mean of every entry over up to `context` windows on both sides."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-context, context)
    return rows.withColumn("smooth", F.array(*[F.avg(F.col(e)[i]).over(w) for i in range(k)]))


def label_lod(e: Column, assigned: Column) -> Column:
    """(assigned - best other) / ln 10; 0 if that is not finite."""
    others = F.filter(e, lambda x, i: i != assigned)
    d = (F.get(e, assigned) - F.array_max(others)) / F.lit(math.log(10))
    return F.when(_finite(d), d).otherwise(0.0)


# Transforms known by one sentence each (contract inferred from that sentence).


def label_smooth(e: Column, a: float) -> Column:
    return F.transform(e, lambda x: (1 - a) * x + a * F.ln(1.0 / F.size(e)))


def floor_at(e: Column, least: float) -> Column:
    return F.transform(e, lambda x: F.greatest(x, F.lit(least)))


def divide_by(e: Column, t: float) -> Column:
    return F.transform(e, lambda x: x / t)


def sparsify(e: Column, k: int, low: float = -100.0) -> Column:
    """The k highest entries stay, the others become low."""
    least = F.get(F.sort_array(e, asc=False), F.lit(k - 1))
    return F.transform(e, lambda x: F.when(least.isNull() | (x >= least), x).otherwise(F.lit(low)))


def ranks(e: Column) -> Column:
    """Each entry's place from below, 1 for the lowest; equal ones share the lower place."""
    s = F.array_sort(e)
    return F.transform(e, lambda x: F.array_position(s, x).cast("double"))


def amplify(e: Column, factor: float) -> Column:
    """Mean plus factor x what lies above it."""
    m = _mean(F.filter(e, _finite))
    return F.transform(e, lambda x: F.when(_finite(x), m + factor * (x - m)).otherwise(x))


def proportion_prior(e: Column, shares: list[float], weight: float) -> Column:
    logs = F.array(*[F.lit(weight * math.log(max(p, 1e-6))) for p in shares])
    return F.zip_with(e, logs, lambda x, y: x + y)


def persistence(e: Column, state: Column, bonus: float) -> Column:
    return F.transform(e, lambda x, i: F.when(i == state, x + bonus).otherwise(x))


def softmax_renormalize(e: Column, temperature: float) -> Column:
    top = F.array_max(e)
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))
    return F.transform(e, lambda x: (x - top) / temperature - F.ln(total))


def with_posterior(e: Column, p: Column, weight: float) -> Column:
    """(1 - w) e + w ln p."""
    return F.zip_with(e, p, lambda x, y: (1 - weight) * x + weight * F.ln(F.greatest(y, F.lit(1e-10))))


def sharpen(p: Column, temperature: float) -> Column:
    """p ** (1 / T), made to sum to 1."""
    q = F.transform(p, lambda x: F.pow(x, F.lit(1.0 / temperature)))
    total = F.aggregate(q, F.lit(0.0), lambda s, x: s + x)
    return F.transform(q, lambda x: x / total)


def focus(e: Column, p: Column, threshold: float) -> Column:
    """-inf where the first pass's posterior is below the threshold, but for the two highest."""
    second = F.get(F.sort_array(p, asc=False), F.lit(1))
    return F.zip_with(e, p, lambda x, y: F.when((y >= threshold) | (y >= second), x).otherwise(F.lit(NONE)))


def confidence_weight(e: Column, power: float) -> Column:
    g = F.pow(margin(e), F.lit(power))
    return F.transform(e, lambda x: x * g)
