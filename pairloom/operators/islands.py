"""Ordered analytics: runs, merges, bridging, boundaries, smoothing. All per group of key
columns, over rows in the order of a position column, with window functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], order: str, state: str, value: str | None = None) -> DataFrame:
    """Maximal runs of equal states: keys, state, first and last position, rows and, with a
    value, its mean, least and most."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    island = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stats = [F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value")] if value else []
    return island.groupBy(*keys, "_run", state).agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count(F.lit(1)).alias("n_windows"), *stats).drop("_run")


def shared_segments(rows: DataFrame, keys: list[str], order: str, state: str, posterior: str, lod: str | None = None, min_windows: int = 1, min_mean_posterior: float = 0.0, min_lod: float | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Runs of state 1 with posterior statistics and the summed LOD, filtered; extra ones are
    further aggregates."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = rows.withColumn("_run", F.sum((F.col(state) != 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col(state) == 1)
    score = F.sum(lod) if lod else F.lit(0.0)
    out = island.groupBy(*keys, "_run").agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count(F.lit(1)).alias("n_windows"), F.avg(posterior).alias("mean_posterior"), F.min(posterior).alias("min_posterior"), F.max(posterior).alias("max_posterior"), score.alias("lod_score"), *extra).drop("_run")
    out = out.filter((F.col("n_windows") >= min_windows) & (F.col("mean_posterior") >= min_mean_posterior))
    return out if min_lod is None else out.filter(F.col("lod_score") >= min_lod)


def composite_filter(segments: DataFrame, soft_min: int, hard_min: int, threshold: float) -> DataFrame:
    """Segments with max(LOD per window, 0) x mean posterior x min(n / soft_min, 1) at least the threshold."""
    score = F.greatest(F.col("lod_score") / F.col("n_windows"), F.lit(0.0)) * F.col("mean_posterior") * F.least(F.col("n_windows") / float(max(1, soft_min)), F.lit(1.0))
    return segments.filter((F.col("n_windows") >= hard_min) & (score >= threshold))


def merge_nearby(segments: DataFrame, keys: list[str], max_gap: int, start: str = "start_idx", end: str = "end_idx", extra: tuple[Column, ...] = ()) -> DataFrame:
    """Segments with a gap of at most max_gap windows become one: windows with the gaps,
    mean weighted by the parts' windows, least and most of the parts, LOD summed."""
    w = Window.partitionBy(*keys).orderBy(start)
    gap = F.col(start) - F.lag(end).over(w) - 1
    island = segments.withColumn("_new", F.coalesce((gap > max_gap).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.col(end) - F.col(start) + 1
    return (
        island.groupBy(*keys, "_run")
        .agg(F.min(start).alias(start), F.max(end).alias(end), (F.sum(n * F.col("mean_posterior")) / F.sum(n)).alias("mean_posterior"), F.min("min_posterior").alias("min_posterior"), F.max("max_posterior").alias("max_posterior"), F.sum("lod_score").alias("lod_score"), *extra)
        .withColumn("n_windows", F.col(end) - F.col(start) + 1)
        .drop("_run")
    )


def bridge_gaps(rows: DataFrame, keys: list[str], order: str, state: str, posterior: str, max_gap: int, least: float) -> DataFrame:
    """bridged: the state, where runs of 0 of at most max_gap rows between runs of 1 become
    1 if their mean posterior reaches `least`."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(*keys, "_run")
    marked = marked.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_mean", F.avg(posterior).over(run)).withColumn("_last", F.max("_run").over(Window.partitionBy(*keys)))
    fill = (F.col(state) == 0) & (F.col("_n") <= max_gap) & (F.col("_mean") >= least) & (F.col("_run") > 1) & (F.col("_run") < F.col("_last"))
    return marked.withColumn("bridged", F.when(fill, F.lit(1)).otherwise(F.col(state))).drop("_new", "_run", "_n", "_mean", "_last")


def extend_states(rows: DataFrame, keys: list[str], order: str, state: str, posterior: str, threshold: float = 0.5) -> DataFrame:
    """extended: runs of 1 grown over neighbouring rows with posterior at the threshold or
    above, as far as they reach: stretches of such rows that touch a 1 become 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    high = ((F.col(posterior) >= threshold) | (F.col(state) == 1)).cast("int")
    marked = rows.withColumn("_h", high).withColumn("_new", F.coalesce((F.lag("_h").over(w) != F.col("_h")).cast("int"), F.lit(1)))
    marked = marked.withColumn("_h", high) if "_h" not in marked.columns else marked
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seeded = F.max(state).over(Window.partitionBy(*keys, "_run")) == 1
    return marked.withColumn("extended", F.when((F.col("_h") == 1) & seeded, F.lit(1)).otherwise(F.lit(0))).drop("_h", "_new", "_run")


def switch_points(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Rows where the state differs from the row before: position, from_state, to_state."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("from_state", F.lag(state).over(w)).filter(F.col("from_state") != F.col(state)).select(*keys, F.col(order).alias("position"), "from_state", F.col(state).alias("to_state"))


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, context: int, name: str = "smoothed") -> DataFrame:
    """Mean over the rows up to `context` before and after; edges have fewer."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-context, context)
    return rows.withColumn(name, F.avg(value).over(w))


def smoothed_weighted(rows: DataFrame, keys: list[str], order: str, value: str, weight: str, context: int) -> DataFrame:
    """Weighted mean over the same frame; the value itself where no weight is positive."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-context, context)
    total = F.sum(weight).over(w)
    return rows.withColumn("smoothed", F.when(total > 0, F.sum(F.col(weight) * F.col(value)).over(w) / total).otherwise(F.col(value)))


def crossings(rows: DataFrame, keys: list[str], order: str, posterior: str, centre: str, level: float = 0.5) -> DataFrame:
    """Where the posterior crosses the level between two rows: the place between their
    centres by linear interpolation, and whether it rises."""
    w = Window.partitionBy(*keys).orderBy(order)
    p0, c0 = F.lag(posterior).over(w), F.lag(centre).over(w)
    marked = rows.withColumn("_p0", p0).withColumn("_c0", c0).filter((F.col("_p0") < level) != (F.col(posterior) < level))
    share = (F.lit(level) - F.col("_p0")) / (F.col(posterior) - F.col("_p0"))
    return marked.select(*keys, F.col(order).alias("position"), F.round(F.col("_c0") + share * (F.col(centre) - F.col("_c0")), 3).alias("crossing"), (F.col(posterior) >= level).alias("rises"))


def refined_boundaries(segments: DataFrame, rows: DataFrame, keys: list[str], order: str, posterior: str, centre: str, level: float = 0.5) -> DataFrame:
    """segments (start_bp, end_bp) with both ends moved to where the posterior crosses the
    level nearest to them, rising at the start and falling at the end, if that is between
    the outer windows' centres around the end; else they stay. Crossings lie between two
    windows, so each end meets the one of its own place: an equi join by window."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = crossings(rows, keys, order, posterior, centre, level).select(*keys, F.col("position").alias("_at"), "crossing", "rises")
    before = rows.select(*keys, F.col(order).alias("_at"), F.lag(order).over(w).alias("_before"))
    rising = at.filter("rises").select(*keys, F.col("_at").alias("first_pos"), F.col("crossing").alias("_start"))
    falling = at.filter("not rises").join(before, [*keys, "_at"]).select(*keys, F.col("_before").alias("last_pos"), F.col("crossing").alias("_end"))
    moved = segments.join(rising, [*keys, "first_pos"], "left").join(falling, [*keys, "last_pos"], "left")
    return moved.withColumn("start_bp", F.coalesce("_start", F.col("start_bp").cast("double"))).withColumn("end_bp", F.coalesce("_end", F.col("end_bp").cast("double"))).drop("_start", "_end")


def smoothing_changes(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Windows whose state a smoothing has changed, per group."""
    return rows.groupBy(*keys).agg(F.count_if(F.col(before) != F.col(after)).alias("changed"))


def nearest(rows: DataFrame, targets: DataFrame, keys: list[str], order: str, tolerance: float) -> DataFrame:
    """distance from each row to the nearest target of its group (null without one) and
    whether that is within the tolerance. Both sides are merged in one order; the last
    target before and the first after are the candidates."""
    both = rows.select(*keys, F.col(order).alias("_p"), F.lit(None).cast("double").alias("_t"), F.lit(1).alias("_row")).unionByName(targets.select(*keys, F.col(order).alias("_p"), F.col(order).cast("double").alias("_t"), F.lit(0).alias("_row")))
    w = Window.partitionBy(*keys).orderBy("_p", "_row")
    before = F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_t", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("_b", before).withColumn("_a", after).filter("_row = 1")
    distance = F.least(F.col("_p") - F.col("_b"), F.col("_a") - F.col("_p"))
    return found.select(*keys, F.col("_p").alias(order), distance.alias("distance"), F.coalesce(distance <= tolerance, F.lit(False)).alias("within"))
