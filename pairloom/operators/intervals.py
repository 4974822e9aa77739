"""Interval algebra on half-open intervals, per group of key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import overlap_bp
from pairloom.operators.rows import bins


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the intervals of each group; touching ones become one."""
    w = Window.partitionBy(*keys).orderBy("start_bp", "end_bp")
    reach = F.max("end_bp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.filter("end_bp > start_bp").withColumn("_new", (reach.isNull() | (F.col("start_bp") > reach)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp")).drop("_island")


def covered(rows: DataFrame, keys: list[str], region: tuple[int, int] | None = None) -> DataFrame:
    """Length of the union of each group's intervals, clipped to the region."""
    if region:
        rows = rows.withColumn("start_bp", F.greatest("start_bp", F.lit(region[0]))).withColumn("end_bp", F.least("end_bp", F.lit(region[1])))
    return merge_intervals(rows, keys).groupBy(*keys).agg(F.sum(F.col("end_bp") - F.col("start_bp")).alias("bp"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], size: int = 20_000) -> DataFrame:
    """All overlapping pairs of a and b in a group: a's columns, b_start, b_end and overlap.
    Intervals are cut into bins and met in the bin where their overlap starts, so the
    join is an equi join and finds each pair once."""
    left = a.withColumn("_bin", bins(F.col("start_bp"), F.col("end_bp"), size))
    right = b.select(*keys, F.col("start_bp").alias("b_start"), F.col("end_bp").alias("b_end"), bins(F.col("start_bp"), F.col("end_bp"), size).alias("_bin"))
    joined = left.join(right, [*keys, "_bin"]).filter((F.col("start_bp") < F.col("b_end")) & (F.col("b_start") < F.col("end_bp")))
    first = F.floor(F.greatest("start_bp", "b_start") / size).cast("long") == F.col("_bin")
    return joined.filter(first).drop("_bin").withColumn("overlap", overlap_bp("start_bp", "end_bp", "b_start", "b_end"))


def intersection(a: DataFrame, b: DataFrame, keys: list[str], merge: bool = True) -> DataFrame:
    """Length of the intersection per group; without merge, overlaps within a side count again."""
    if merge:
        a, b = merge_intervals(a, keys), merge_intervals(b, keys)
    return overlaps(a, b, keys).groupBy(*keys).agg(F.sum("overlap").alias("bp"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: lengths of both unions and of their intersection, Jaccard, precision
    (of a) and recall (of b); 0 where nothing is to divide by."""
    la, lb = covered(a, keys).withColumnRenamed("bp", "a_bp"), covered(b, keys).withColumnRenamed("bp", "b_bp")
    both = la.join(lb, keys, "full_outer").join(intersection(a, b, keys).withColumnRenamed("bp", "ab_bp"), keys, "left").na.fill(0, ["a_bp", "b_bp", "ab_bp"])
    ratio = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 6)
    union = F.col("a_bp") + F.col("b_bp") - F.col("ab_bp")
    return both.select(*keys, "a_bp", "b_bp", "ab_bp", ratio(F.col("ab_bp"), union).alias("jaccard"), ratio(F.col("ab_bp"), F.col("a_bp")).alias("precision"), ratio(F.col("ab_bp"), F.col("b_bp")).alias("recall"))


def matched(a: DataFrame, b: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Overlapping pairs whose overlap is at least `share` of the shorter one."""
    shorter = F.least(F.col("end_bp") - F.col("start_bp"), F.col("b_end") - F.col("b_start"))
    return overlaps(a, b, keys).filter((shorter > 0) & (F.col("overlap") / shorter >= share))


def length_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson's correlation of the lengths of matched pairs; 0 if it is not defined."""
    x, y = (F.col("end_bp") - F.col("start_bp")).cast("double"), (F.col("b_end") - F.col("b_start")).cast("double")
    return pairs.agg(F.round(F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)), 6).alias("length_correlation"))


def boundary_accuracy(pairs: DataFrame, within: int) -> DataFrame:
    """Distances of the ends of matched pairs: mean, median and most of starts and ends
    together, and the share within a distance."""
    d = pairs.select(F.explode(F.array(F.abs(F.col("start_bp") - F.col("b_start")), F.abs(F.col("end_bp") - F.col("b_end")))).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_bp"), F.round(F.median("d"), 6).alias("median_bp"), F.max("d").alias("max_bp"), F.round(F.avg((F.col("d") <= within).cast("double")), 6).alias("frac_within"))


def called_windows(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Windows of the grid over half of which the group's intervals cover."""
    merged = merge_intervals(rows, keys).withColumn("window", bins(F.col("start_bp"), F.col("end_bp"), size))
    bp = overlap_bp("start_bp", "end_bp", F.col("window") * size, (F.col("window") + 1) * size)
    return merged.groupBy(*keys, "window").agg(F.sum(bp).alias("bp")).filter(F.col("bp") > size // 2).select(*keys, "window")


def window_concordance(a: DataFrame, b: DataFrame, keys: list[str], size: int, windows: int) -> DataFrame:
    """Share of the grid's windows on which both agree, per group."""
    x = called_windows(a, keys, size).withColumn("in_a", F.lit(1))
    y = called_windows(b, keys, size).withColumn("in_b", F.lit(1))
    differ = x.join(y, [*keys, "window"], "full_outer").groupBy(*keys).agg(F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("differ"))
    return differ.select(*keys, F.round((F.lit(windows) - F.col("differ")) / windows, 6).alias("concordance"))
