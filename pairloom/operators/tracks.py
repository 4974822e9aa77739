"""Runs of high identity over a grid on which windows may be missing, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RUN = "struct<start:bigint,start_bp:bigint,last:bigint,last_end:bigint,gaps:bigint,n:bigint,total:double,least:double>"
_DONE = "struct<start_idx:bigint,start_bp:bigint,end_idx:bigint,end_bp:bigint,n_called:bigint,identity_sum:double,min_identity:double>"


def tolerant_runs(rows: DataFrame, keys: list[str], total: int, window: int, min_identity: float = 0.9995, max_gap: int = 1, min_windows: int = 3, min_len_bp: int = 5000, drop: float = 0.0) -> DataFrame:
    """Runs of windows of at least min_identity - drop. rows: keys, idx (0 to total - 1),
    start_bp, end_bp, identity of the called windows of a regular grid.

    Missing windows inside a run count against max_gap all together, not consecutive ones
    only; the one that is too many ends the run at the window before it, and a run keeps
    the missing windows at its end. One window function cannot say where the count starts
    anew, so each group's windows, at most a chromosome's, are folded in the JVM."""
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("idx", "bigint"), ("start_bp", "bigint"), ("end_bp", "bigint"), ("identity", "double"))]))).alias("w"))
    ended = lambda r, gap: f"named_struct('start_idx', {r}.start, 'start_bp', {r}.start_bp, 'end_idx', {r}.last + {gap}, 'end_bp', {r}.last_end + ({gap}) * {window}, 'n_called', {r}.n, 'identity_sum', {r}.total, 'min_identity', {r}.least)"
    opened = f"cast(named_struct('start', x.idx, 'start_bp', x.start_bp, 'last', x.idx, 'last_end', x.end_bp, 'gaps', 0L, 'n', 1L, 'total', x.identity, 'least', x.identity) as {_RUN})"
    grown = f"cast(named_struct('start', a.run.start, 'start_bp', a.run.start_bp, 'last', x.idx, 'last_end', x.end_bp, 'gaps', a.run.gaps + x.idx - a.run.last - 1, 'n', a.run.n + 1, 'total', a.run.total + x.identity, 'least', least(a.run.least, x.identity)) as {_RUN})"
    good = f"x.identity >= {min_identity - drop!r}D"
    missing = "x.idx - a.run.last - 1"
    room = f"{max_gap} - a.run.gaps"
    step = f"""case when a.run is null then named_struct('done', a.done, 'run', case when {good} then {opened} end)
        when {missing} > {room} then named_struct('done', concat(a.done, array(cast({ended('a.run', room)} as {_DONE}))), 'run', case when {good} then {opened} end)
        when {good} then named_struct('done', a.done, 'run', {grown})
        else named_struct('done', concat(a.done, array(cast({ended('a.run', missing)} as {_DONE}))), 'run', cast(null as {_RUN})) end"""
    start = f"named_struct('done', cast(array() as array<{_DONE}>), 'run', cast(null as {_RUN}))"
    last = f"least({max_gap} - a.run.gaps, {total - 1} - a.run.last)"
    finish = f"case when a.run is null then a.done else concat(a.done, array(cast({ended('a.run', last)} as {_DONE}))) end"
    found = grouped.select(*keys, F.expr(f"inline(aggregate(w, {start}, (a, x) -> {step}, a -> {finish}))"))
    out = found.withColumn("n_windows", F.col("end_idx") - F.col("start_idx") + 1).filter((F.col("n_windows") >= min_windows) & (F.col("end_bp") - F.col("start_bp") + 1 >= min_len_bp))
    return out.withColumn("mean_identity", F.col("identity_sum") / F.col("n_called"))


def fraction_called(n_called="n_called", n_windows="n_windows"):
    """Called windows of a run's windows; 0 without windows."""
    return F.when(F.col(n_windows) > 0, F.col(n_called) / F.col(n_windows)).otherwise(0.0)


def merge_overlapping(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of a group that share windows become one. A later one adds the part of its
    identity sum and of its called windows (rounded) that lies beyond the reach so far."""
    w = Window.partitionBy(*keys).orderBy("start_bp", "end_bp", "start_idx", "end_idx")
    reach = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.withColumn("_reach", reach).withColumn("_new", (F.col("_reach").isNull() | (F.col("start_idx") > F.col("_reach"))).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fresh = F.when(F.col("_new") == 1, 1.0).otherwise(F.greatest(F.col("end_idx") - F.col("_reach"), F.lit(0)) / (F.col("end_idx") - F.col("start_idx") + 1))
    out = island.withColumn("_fresh", fresh).groupBy(*keys, "_island").agg(
        F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp"),
        F.sum(F.col("identity_sum") * F.col("_fresh")).alias("identity_sum"), F.sum(F.floor(F.col("n_called") * F.col("_fresh") + 0.5).cast("long")).alias("n_called"), F.min("min_identity").alias("min_identity"),
    )
    return out.withColumn("n_windows", F.col("end_idx") - F.col("start_idx") + 1).withColumn("mean_identity", F.when(F.col("n_called") > 0, F.col("identity_sum") / F.col("n_called"))).drop("_island")


def posterior_std(windows: DataFrame, keys: list[str], posterior: str = "posterior"):
    """Sample standard deviation of the posteriors of each segment; 0 below two windows."""
    return windows.groupBy(*keys).agg(F.coalesce(F.stddev_samp(posterior), F.lit(0.0)).alias("posterior_std"))
