"""Operators on the panel in long form: sample, chrom, start_bp, end_bp, population,
haplotype, identity. One row says how alike a query and one reference haplotype are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ = ["sample", "chrom"]
WIN = [*SEQ, "start_bp", "end_bp"]


def numbered(long: DataFrame) -> DataFrame:
    """idx: the place of each row's window among those of its sample and chromosome."""
    return long.withColumn("idx", F.dense_rank().over(Window.partitionBy(*SEQ).orderBy("start_bp", "end_bp")))


def smoothed(long: DataFrame, context: int) -> DataFrame:
    """Each haplotype's mean over the windows up to `context` away in which it has data."""
    if not context:
        return long
    w = Window.partitionBy(*SEQ, "haplotype").orderBy("idx").rangeBetween(-context, context)
    has = F.when(F.col("identity") > 0, F.col("identity"))
    return numbered(long).withColumn("identity", F.coalesce(F.when(F.col("identity") > 0, F.avg(has).over(w)), F.col("identity"))).drop("idx")


def best_haplotype(long: DataFrame) -> DataFrame:
    """One row a window with data: the best haplotype (of equal ones the first by name), its
    population and identity."""
    best = long.filter("identity > 0").withColumn("_r", F.row_number().over(Window.partitionBy(*WIN).orderBy(F.desc("identity"), "haplotype")))
    return best.filter("_r = 1").select(*WIN, "haplotype", "population", "identity")


def haplotype_agreement(long: DataFrame, context: int) -> DataFrame:
    """share: of the other windows up to `context` away, those with the same best haplotype."""
    w = Window.partitionBy(*SEQ).orderBy("start_bp", "end_bp").rowsBetween(-context, context)
    around = F.collect_list("haplotype").over(w)
    best = best_haplotype(long).withColumn("_a", around)
    same = F.size(F.filter("_a", lambda h: h == F.col("haplotype"))) - 1
    return best.withColumn("share", F.when(F.size("_a") > 1, same / (F.size("_a") - 1)).otherwise(0.0)).drop("_a")


def bonus(long: DataFrame, names: list[str], context: int, weight: float, temperature: float) -> DataFrame:
    """bonus: for the population of each window's best haplotype weight x temperature x share."""
    found = haplotype_agreement(long, context)
    cells = [F.when(F.col("population") == n, weight * temperature * F.col("share")).otherwise(0.0) for n in names]
    return found.select(*WIN, F.array(*cells).alias("bonus"))


def rank_shares(long: DataFrame, names: list[str], top: int = 0, haplotypes: int | None = None) -> DataFrame:
    """ranked: ln of each population's share among the top haplotypes of a window, with half a
    pseudo-count; top 0 takes as many as a population has on average."""
    top = top or max(1, (haplotypes or 0) // len(names))
    w = Window.partitionBy(*WIN).orderBy(F.desc("identity"), "haplotype")
    first = long.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    counts = [(F.count_if(F.col("population") == n) + 0.5).alias(f"_n{k}") for k, n in enumerate(names)]
    total = sum((F.col(f"_n{k}") for k in range(1, len(names))), F.col("_n0"))
    return first.groupBy(*WIN).agg(*counts).select(*WIN, F.array(*[F.ln(F.col(f"_n{k}") / total) for k in range(len(names))]).alias("ranked"))


def normalization(seen: DataFrame, names: list[str]) -> DataFrame:
    """population, mean, std of the windows' similarities above 0; std at least 1e-6, and that
    for under two windows; mean 0 without any. seen: sims by population."""
    parts = seen.select(F.posexplode("sims").alias("k", "sim")).filter("sim > 0").groupBy("k").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.count(F.lit(1)).alias("n"))
    every = seen.sparkSession.createDataFrame(list(enumerate(names)), "k int, population string")
    std = F.when(F.col("n") >= 2, F.greatest(F.col("std"), F.lit(1e-6))).otherwise(F.lit(1e-6))
    return every.join(parts, "k", "left").select("population", F.coalesce("mean", F.lit(0.0)).alias("mean"), std.alias("std"))


def same_and_other(seen: DataFrame) -> DataFrame:
    """Mean and deviation of the windows' best similarity, and of their other ones above 0."""
    best = F.array_max("sims")
    at = F.array_position("sims", best) - 1
    rows = seen.filter(best > 0).select(F.posexplode("sims").alias("k", "sim"), at.alias("at")).filter("sim > 0")
    own = F.col("k") == F.col("at")
    stat = lambda f, cond, name: f(F.when(cond, F.col("sim"))).alias(name)
    return rows.agg(stat(F.avg, own, "same_mean"), stat(F.stddev_pop, own, "same_std"), stat(F.avg, ~own, "other_mean"), stat(F.stddev_pop, ~own, "other_std"))


def effect_sizes(seen: DataFrame, names: list[str]) -> DataFrame:
    """a, b, d, gap: the effect size between any two populations' similarities (at most 100
    where nothing varies) and the distance of their means."""
    rows = seen.select(F.posexplode("sims").alias("k", "sim")).groupBy("k").agg(F.avg("sim").alias("m"), F.var_samp("sim").alias("v"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("k").alias("k"), F.col("m").alias("m"), F.col("v").alias("v")))).alias("s"))
    pairs = "flatten(transform(s, x -> transform(filter(s, y -> y.k > x.k), y -> struct(x.k as a, y.k as b, abs(x.m - y.m) as gap, sqrt((x.v + y.v) / 2) as pooled))))"
    d = F.least(F.lit(100.0), F.when(F.col("pooled") > 0, F.col("gap") / F.col("pooled")).when(F.col("gap") > 0, F.lit(100.0)).otherwise(0.0))
    label = F.array(*[F.lit(n) for n in names])
    return whole.select(F.expr(f"inline({pairs})")).select(F.get(label, F.col("a")).alias("a"), F.get(label, F.col("b")).alias("b"), d.alias("d"), "gap")


def window_variance(long: DataFrame, names: list[str]) -> DataFrame:
    """variance: of each population's similarities above 0 within a window; 0 for under two."""
    has = F.when(F.col("identity") > 0, F.col("identity"))
    cells = [F.coalesce(F.var_pop(F.when(F.col("population") == n, has)), F.lit(0.0)) for n in names]
    return long.groupBy(*WIN).agg(F.array(*cells).alias("variance"))


def without_best(long: DataFrame, names: list[str], model: str = "max") -> DataFrame:
    """sims_loo: each population's lowest aggregate when any one of its haplotypes is left out,
    which is that without its best one; a lone haplotype stays. max and mean."""
    w = Window.partitionBy(*WIN, "population").orderBy(F.desc("identity"), "haplotype")
    ranked = long.filter("identity > 0").withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*WIN, "population")))
    rest = ranked.filter("_r > 1 or _n = 1")
    agg = {"max": F.max, "mean": F.avg}[model]
    cells = [F.coalesce(agg(F.when(F.col("population") == n, F.col("identity"))), F.lit(0.0)) for n in names]
    return rest.groupBy(*WIN).agg(F.array(*cells).alias("sims_loo"))


def purity(long: DataFrame) -> DataFrame:
    """haplotype, purity: of the windows in which a reference haplotype is the best one, the
    share whose second-best haplotype is of the same population, with one pseudo-count for
    and one against. (Known from one sentence; inferred.)"""
    w = Window.partitionBy(*WIN).orderBy(F.desc("identity"), "haplotype")
    ranked = long.filter("identity > 0").withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("population").over(w)).filter("_r = 1 and _next is not null")
    won = ranked.groupBy("haplotype").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_next") == F.col("population")).alias("own"))
    return won.select("haplotype", ((F.col("own") + 1) / (F.col("n") + 2)).alias("purity"))


def weighted_by_purity(long: DataFrame, pure: DataFrame, power: float = 1.0) -> DataFrame:
    """identity x purity ** power; haplotypes without a purity stay. One row a reference
    haplotype: Spark's own size check decides on a broadcast."""
    return long.join(pure, "haplotype", "left").withColumn("identity", F.col("identity") * F.pow(F.coalesce("purity", F.lit(1.0)), F.lit(power))).drop("purity").select(*long.columns)


def coverage_emissions(long: DataFrame, names: list[str], coverage: str = "coverage", temperature: float = 1.0) -> DataFrame:
    """covered: log-softmax over populations of their highest coverage ratio."""
    cells = [F.coalesce(F.max(F.when(F.col("population") == n, F.col(coverage))), F.lit(0.0)) for n in names]
    rows = long.groupBy(*WIN).agg(F.array(*cells).alias("_c"))
    from pairloom.operators.emissions import log_softmax

    return rows.select(*WIN, log_softmax(F.col("_c"), temperature).alias("covered"))


def segments_in(gold: DataFrame, *, pair: tuple[str, str] | None = None, chrom: str | None = None, min_lod: float | None = None) -> DataFrame:
    """Gold segments of a pair of samples in either order, of a chromosome, above a LOD."""
    if pair:
        a, b = pair
        gold = gold.filter(((F.col("sample1") == a) & (F.col("sample2") == b)) | ((F.col("sample1") == b) & (F.col("sample2") == a)))
    if chrom:
        gold = gold.filter(F.col("chrom") == chrom)
    return gold if min_lod is None else gold.filter(F.col("lod") >= min_lod)


def unique_pairs(gold: DataFrame) -> DataFrame:
    """The unordered pairs of samples of gold segments, each once."""
    return gold.select(F.least("sample1", "sample2").alias("sample1"), F.greatest("sample1", "sample2").alias("sample2")).distinct()


def agreement_scales(sizes: dict[tuple[int, int], float], k: int, n: int, agree: float, disagree: float) -> tuple[list[float], list[list[float]]]:
    """Scales of the blend by population and by pair, from the effect sizes of pairs: a
    population far from its nearest one counts more where both models agree, and a close
    pair is damped less where they differ. The given scales for under ten windows or two
    populations. (Known from tests of its order only; inferred.)"""
    if n < 10 or k < 2:
        return [agree] * k, [[disagree] * k for _ in range(k)]
    d = lambda i, j: sizes[min(i, j), max(i, j)]
    nearest = [min(d(i, j) for j in range(k) if j != i) for i in range(k)]
    mean = sum(nearest) / k
    mid = sum(sizes.values()) / len(sizes)
    scale = [agree * (2 * x / (x + mean) if x + mean > 0 else 1.0) for x in nearest]
    matrix = [[disagree if i == j or mid <= 0 else min(1.0, disagree * 2 * mid / (d(i, j) + mid)) for j in range(k)] for i in range(k)]
    return scale, matrix


def configured(sizes: list[float], n: int) -> tuple[float, int]:
    """Pairwise weight and emission context from the effect sizes of n windows; see
    kernels.estimates.auto_configure for the rule."""
    if n < 10 or not sizes:
        return 0.3, 0
    least, mean = min(sizes), sum(sizes) / len(sizes)
    context = int(min(max(round(0.1 / least), 1), 15)) if least > 0 else 15
    std = math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))
    cv = 1.0 if len(sizes) == 1 else (std / mean) / (0.4 + std / mean) if mean > 0 else 0.0
    return min(0.7 * cv * min(least / 0.014, 1) * min(math.sqrt(n / 5000), 1), 0.95), context


def switch_column(state: str) -> Column:
    """Whether the state differs from that of the window before."""
    return F.coalesce(F.lag(state).over(Window.partitionBy(*SEQ).orderBy("start_bp")) != F.col(state), F.lit(False))
