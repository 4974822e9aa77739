"""Genetic maps: positions in centimorgans, distances, and what they do to switch rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions are sorted by bins of 2**BIN_BITS base pairs.
BIN_BITS = 20


def uniform_map(spark: SparkSession, chrom: str, start: int, end: int, rate: float) -> DataFrame:
    """A map of one piece: rate centimorgans a megabase from start to end."""
    return spark.createDataFrame([(chrom, start, 0.0), (chrom, end, (end - start) * rate / 1e6)], "chrom string, bp long, cm double")


def summary(gmap: DataFrame) -> DataFrame:
    """Of each chromosome's map: entries, first and last position, length in centimorgans and
    the mean rate a megabase."""
    ends = gmap.groupBy("chrom").agg(F.count(F.lit(1)).alias("entries"), F.min("bp").alias("first_bp"), F.max("bp").alias("last_bp"), F.min_by("cm", "bp").alias("_a"), F.max_by("cm", "bp").alias("_b"))
    span = F.col("last_bp") - F.col("first_bp")
    return ends.select("chrom", "entries", "first_bp", "last_bp", (F.col("_b") - F.col("_a")).alias("length_cm"), F.when(span > 0, (F.col("_b") - F.col("_a")) / span * 1e6).otherwise(0.0).alias("cm_per_mb"))


def interpolate(rows: DataFrame, gmap: DataFrame, position: str = "pos", name: str = "cm_at") -> DataFrame:
    """Adds the centimorgans of each row's (chrom, position): linear between entries,
    extrapolated with the rate of the first and last piece. A map of one entry has no rate;
    chromosomes without a map give null.

    Map and distinct positions are merged in one order by chromosome and bin, where a
    position takes the entry before it. A bin starts with the last entry before it, or else
    with the chromosome's first one; only bins and entries are sorted by chromosome."""
    w = Window.partitionBy("chrom").orderBy("bp", "cm")
    rate = lambda cm1, bp1, cm0, bp0: F.when(bp1 > bp0, (cm1 - cm0) / (bp1 - bp0)).otherwise(0.0)
    nb, nc, pb, pc = F.lead("bp").over(w), F.lead("cm").over(w), F.lag("bp").over(w), F.lag("cm").over(w)
    own = F.when(nb.isNotNull(), rate(nc, nb, F.col("cm"), F.col("bp"))).when(pb.isNotNull(), rate(F.col("cm"), F.col("bp"), pc, pb)).otherwise(0.0)
    bin_of = lambda c: F.shiftright(c, BIN_BITS)
    bp = F.col("bp").cast("long")
    entries = gmap.select("chrom", bin_of(bp).alias("_bin"), bp.alias("_p"), F.lit(0).alias("_row"), F.col("cm").alias("_o"), F.struct(bp.alias("bp"), "cm", own.alias("rate")).alias("_piece"), F.row_number().over(w).alias("_k"))
    none = F.lit(None).cast(entries.schema["_piece"].dataType).alias("_piece")
    asked = rows.select("chrom", F.col(position).cast("long").alias("_p")).filter("chrom is not null and _p is not null").distinct()
    asked = asked.select("chrom", bin_of("_p").alias("_bin"), "_p", F.lit(1).alias("_row"), F.lit(0.0).alias("_o"), none)
    until_now = lambda o: F.last("_piece", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    # Bins, each before its own entries; a chromosome's first entry holds before all bins.
    first = entries.filter("_k = 1").withColumn("_bin", F.lit(None).cast("long"))
    entries, first = entries.drop("_k"), first.drop("_k")
    starts = asked.select("chrom", "_bin").distinct().select("chrom", "_bin", F.shiftleft("_bin", BIN_BITS).alias("_p"), F.lit(-1).alias("_row"), F.lit(0.0).alias("_o"), none)
    bins = entries.unionByName(first).unionByName(starts)
    starts = bins.withColumn("_piece", until_now(Window.partitionBy("chrom").orderBy("_bin", "_row", "_p", "_o"))).filter("_row = -1")

    both = entries.unionByName(starts).unionByName(asked)
    found = both.withColumn("_at", until_now(Window.partitionBy("chrom", "_bin").orderBy("_p", "_row", "_o"))).filter("_row = 1")
    cm = F.col("_at.cm") + F.col("_at.rate") * (F.col("_p") - F.col("_at.bp"))
    return rows.join(found.select(F.col("chrom").alias("_c"), "_p", cm.alias(name)), (F.col("chrom") == F.col("_c")) & (F.col(position) == F.col("_p")), "left").drop("_c", "_p")


def distances(windows: DataFrame, gmap: DataFrame, keys: list[str], size: int) -> DataFrame:
    """windows (keys, chrom, start_bp, end_bp) with mid, cm at the middle and cm_next one
    window further, and with the distances to the window before: step_bp and step_cm."""
    mid = F.floor((F.col("start_bp") + F.col("end_bp")) / 2).cast("long")
    places = windows.withColumn("mid", mid).withColumn("_next", mid + size)
    placed = interpolate(interpolate(places, gmap, "mid", "cm"), gmap, "_next", "cm_next").drop("_next")
    w = Window.partitionBy(*keys).orderBy("start_bp", "end_bp")
    return placed.withColumn("step_bp", F.col("mid") - F.lag("mid").over(w)).withColumn("step_cm", F.abs(F.col("cm") - F.lag("cm").over(w)))


def haldane(cm: Column) -> Column:
    """Recombination fraction of a distance in centimorgans."""
    return F.lit(0.5) * (1 - F.exp(-cm / 50.0))


def modulated_switch(base: float, step_cm: str | Column = "step_cm", step_bp: str | Column = "step_bp") -> Column:
    """The base rate times Haldane's fraction of the map distance over that of the same
    distance at one centimorgan a megabase, within 1e-6 and 0.5."""
    cm, bp = (F.col(c) if isinstance(c, str) else c for c in (step_cm, step_bp))
    nominal = haldane(bp / 1e6)
    scaled = F.when(nominal > 0, base * haldane(cm) / nominal).otherwise(F.lit(float(base)))
    return F.least(F.lit(0.5), F.greatest(F.lit(1e-6), scaled))


def map_rates(enter: float, leave: float, size: int) -> tuple[Column, Column]:
    """Entering and leaving probabilities of a step between two windows by their map
    distance, over columns of distances(): rates are scaled by the distance over that of
    one window at the step's start (one centimorgan a megabase if there is none), and
    leaving also by one plus Haldane's fraction; within 1e-10 and 1 - 1e-10. A step
    without distance, or windows of size 0, take the probabilities as they are."""
    nominal = F.abs(F.col("from_cm_next") - F.col("from_cm"))
    scale = F.col("step_cm") / F.when(nominal > 0, nominal).otherwise(size / 1e6)
    plain = F.lit(size == 0) | (F.col("step_bp") == 0)

    def scaled(p: float, factor: Column) -> Column:
        moved = 1 - F.exp(F.log1p(F.lit(-float(p))) * factor)
        return F.when(plain, F.lit(float(p))).otherwise(F.least(F.lit(1 - 1e-10), F.greatest(F.lit(1e-10), moved)))

    return scaled(enter, scale), scaled(leave, scale * (1 + haldane(F.col("step_cm"))))
