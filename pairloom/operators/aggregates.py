"""Aggregates over similarity rows, segments and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import inv_logit


def enrichment(pairs: DataFrame, threshold: float = 0.999) -> DataFrame:
    """Per window: pairs, pairs at or above the threshold, and their share."""
    n = F.count(F.lit(1))
    high = F.count_if(F.col("identity") >= threshold)
    return pairs.groupBy("chrom", "start_bp", "end_bp").agg(n.alias("n_pairs"), high.alias("n_ibs"), F.round(high / n, 6).alias("frac_ibs"))


def haplotype_baselines(pairs: DataFrame) -> DataFrame:
    """Per haplotype and window: mean identity of all pairs that it is in."""
    both = pairs.select("chrom", "start_bp", "identity", F.explode(F.array("hap_a", "hap_b")).alias("hap"))
    return both.groupBy("chrom", "hap", "start_bp").agg(F.avg("identity").alias("baseline"))


def contrast_adjust(pairs: DataFrame) -> DataFrame:
    """adjusted: identity less what either haplotype has above the window's mean, within 0 and 1.

    One shuffle, by window: the mean, the baselines of both haplotypes and the way back to
    the rows all stay inside the window's partition."""
    place = Window.partitionBy("chrom", "start_bp")
    rows = pairs.repartition("chrom", "start_bp").withColumn("_mu", F.avg("identity").over(place)).withColumn("_row", F.monotonically_increasing_id())
    ends = rows.select("*", F.explode(F.array(F.struct(F.col("hap_a").alias("hap"), F.lit(0).alias("side")), F.struct(F.col("hap_b").alias("hap"), F.lit(1).alias("side")))).alias("_s"))
    based = ends.withColumn("_hap", F.col("_s.hap")).withColumn("_base", F.avg("identity").over(Window.partitionBy("chrom", "start_bp", "_hap")))
    side = lambda k: F.max(F.when(F.col("_s.side") == k, F.col("_base"))) - F.col("_mu")
    back = based.groupBy(*pairs.columns, "_mu", "_row").agg((side(0) + side(1)).alias("_above"))
    return back.withColumn("adjusted", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("identity") - F.col("_above")))).drop("_mu", "_row", "_above")


def window_background(pairs: DataFrame, threshold: float = 0.999, floor: float = 0.0) -> DataFrame:
    """Per window: rows at or above the threshold, all rows, mean and population deviation."""
    used = pairs.filter(F.col("identity") >= floor)
    return used.groupBy("chrom", "start_bp", "end_bp").agg(F.count_if(F.col("identity") >= threshold).alias("n_high"), F.count(F.lit(1)).alias("n"), F.avg("identity").alias("mean"), F.stddev_pop("identity").alias("std"))


def background_filter(pairs: DataFrame, threshold: float = 0.999, ratio: float = 0.5, floor: float = 0.0) -> DataFrame:
    """Without the windows in which over `ratio` of the rows reach the threshold."""
    noisy = window_background(pairs, threshold, floor).filter(F.col("n_high") / F.col("n") > ratio).select("chrom", "start_bp", "end_bp")
    return pairs.join(noisy, ["chrom", "start_bp", "end_bp"], "left_anti")


def background_normalize(pairs: DataFrame) -> DataFrame:
    """normalized: the logistic of the z-score within the window; windows with one row or
    hardly any spread keep the identity."""
    stats = window_background(pairs).filter("n > 1 and std >= 1e-8").select("chrom", "start_bp", "end_bp", "mean", "std")
    joined = pairs.join(stats, ["chrom", "start_bp", "end_bp"], "left")
    z = (F.col("identity") - F.col("mean")) / F.col("std")
    return joined.withColumn("normalized", F.coalesce(inv_logit(z), F.col("identity"))).drop("mean", "std")


def length_stats(segments: DataFrame, length="end_bp - start_bp") -> DataFrame:
    """One row: count, mean, median, sample deviation (0 for one), least, most and total length."""
    n = F.expr(length)
    return segments.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_len"), F.round(F.median(n), 6).alias("median_len"),
        F.round(F.coalesce(F.stddev_samp(n), F.lit(0.0)), 6).alias("std_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(n).alias("total_len"),
    )


def length_histogram(segments: DataFrame, size: int, length="end_bp - start_bp") -> DataFrame:
    """bin_start and count of the bins that are not empty."""
    start = (F.floor(F.expr(length) / size) * size).cast("long")
    return segments.groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def trimmed_mean(rows: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Mean without the floor(n x fraction) lowest and highest values of each group."""
    w = Window.partitionBy(*keys)
    k = F.floor(F.col("_n") * fraction)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.filter((F.col("_r") > k) & (F.col("_r") <= F.col("_n") - k)).groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"))


def top_share_std(rows: DataFrame, keys: list[str], value: str, share: float = 0.05, least: int = 5, low: float = 0.0003, high: float = 0.002) -> DataFrame:
    """Population deviation of the highest max(least, ceil(n x share)) values of groups of
    20 or more, kept within bounds."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(value)))).withColumn("_n", F.count(F.lit(1)).over(w))
    top = ranked.filter("_n >= 20").filter(F.col("_r") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share)))
    return top.groupBy(*keys).agg(F.least(F.lit(high), F.greatest(F.lit(low), F.stddev_pop(value))).alias("top_std"))


def block_means(rows: DataFrame, keys: list[str], order: str, value: str, factor: int) -> DataFrame:
    """Means over blocks of `factor` consecutive rows."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("block", F.floor(at / factor).cast("long")).groupBy(*keys, "block").agg(F.avg(value).alias("mean"))


def weighted_emissions(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean and deviation of a value in two states, weighted by the posterior and the rest."""
    w1, w0, x = F.col(weight), 1 - F.col(weight), F.col(value)
    sums = rows.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in (("s1", w1), ("s0", w0), ("x1", w1 * x), ("x0", w0 * x), ("q1", w1 * x * x), ("q0", w0 * x * x))])
    mean = lambda k: F.try_divide(F.col(f"x{k}"), F.col(f"s{k}"))
    std = lambda k: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"q{k}"), F.col(f"s{k}")) - mean(k) * mean(k)))
    return sums.select(*keys, *[f(k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", mean), ("std", std))])


def indicator_rates(rows: DataFrame, keys: list[str], indicator: str, weight: str) -> DataFrame:
    """Weighted rate of an indicator in both states, within .001 and .999; priors .22 and
    .015 where a state has no weight. rate1 belongs to the weight's state."""
    clamp = lambda c: F.least(F.lit(0.999), F.greatest(F.lit(0.001), c))
    rate = lambda w, prior: F.coalesce(clamp(F.try_divide(F.sum(w * F.col(indicator)), F.nullif(F.sum(w), F.lit(0.0)))), F.lit(prior))
    return rows.groupBy(*keys).agg(rate(1 - F.col(weight), 0.015).alias("rate0"), rate(F.col(weight), 0.22).alias("rate1"))


def admixture(segments: DataFrame) -> DataFrame:
    """(sample, ancestry, start_bp, end_bp) -> bp, proportion of the sample's bp and mean
    tract per ancestry, and the sample's number of switches."""
    w = Window.partitionBy("sample")
    order = w.orderBy("start_bp", "end_bp")
    marked = segments.withColumn("_s", (F.lag("ancestry").over(order) != F.col("ancestry")).cast("int"))
    switches = marked.groupBy("sample").agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("n_switches"))
    length = F.col("end_bp") - F.col("start_bp")
    per = segments.groupBy("sample", "ancestry").agg(F.sum(length).alias("bp"), F.count(F.lit(1)).alias("n_tracts"), F.round(F.avg(length), 6).alias("mean_tract"))
    per = per.withColumn("proportion", F.round(F.col("bp") / F.sum("bp").over(w), 6))
    return per.join(switches, "sample")


def confusion(rows: DataFrame, truth: str, called: str, labels: DataFrame | None = None) -> DataFrame:
    """Long confusion table: true_pop, called_pop, n; with labels (one column, label) every
    pair of them has a row, zeros too."""
    counts = rows.groupBy(F.col(truth).alias("true_pop"), F.col(called).alias("called_pop")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        return counts
    every = labels.agg(F.collect_set("label").alias("a")).select(F.explode("a").alias("true_pop"), "a").select("true_pop", F.explode("a").alias("called_pop"))
    return every.join(counts, ["true_pop", "called_pop"], "left").na.fill(0, ["n"])


def class_metrics(rows: DataFrame, truth: str, called: str) -> DataFrame:
    """Precision, recall and F1 of every class; 0 where a denominator is."""
    t = rows.groupBy(F.col(truth).alias("class")).agg(F.count(F.lit(1)).alias("actual"), F.count_if(F.col(truth) == F.col(called)).alias("hit"))
    c = rows.groupBy(F.col(called).alias("class")).agg(F.count(F.lit(1)).alias("called"))
    both = t.join(c, "class", "full_outer").na.fill(0, ["actual", "hit", "called"])
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(0.0)
    p, r = ratio("called"), ratio("actual")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return both.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
