"""Kinship and relationship matrices, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import sample_of


def kinship(segments: DataFrame, genome: int, pairs: DataFrame | None = None) -> DataFrame:
    """total_ibd_bp per unordered pair of individuals and theta_hat = bp / 4 genome; with a
    list of pairs (individual_a, individual_b) those only, with 0 where nothing is shared."""
    a, b = sample_of("hap_a"), sample_of("hap_b")
    sums = segments.select(F.least(a, b).alias("individual_a"), F.greatest(a, b).alias("individual_b"), (F.col("end_bp") - F.col("start_bp")).alias("bp")).filter("individual_a <> individual_b").groupBy("individual_a", "individual_b").agg(F.sum("bp").alias("total_ibd_bp"))
    if pairs is not None:
        sums = pairs.join(sums, ["individual_a", "individual_b"], "left").na.fill(0, ["total_ibd_bp"])
    return sums.withColumn("theta_hat", F.round(F.col("total_ibd_bp") / (4.0 * genome), 9))


def relationship(pairs: DataFrame) -> DataFrame:
    """Mean identity and count of every unordered pair of haplotypes over all windows."""
    return pairs.groupBy("hap_a", "hap_b").agg(F.avg("identity").alias("average"), F.count(F.lit(1)).alias("n"))


def centered(matrix: DataFrame) -> DataFrame:
    """The averages less their grand mean."""
    return matrix.withColumn("centered", F.col("average") - matrix.agg(F.avg("average")).scalar())


def diploid(matrix: DataFrame) -> DataFrame:
    """Individuals: the mean of the up to four comparisons of their haplotypes; an
    individual's own haplotypes are 1 with themselves."""
    one = lambda x, y, average, times: F.struct(F.col(x).alias("hap_a"), F.col(y).alias("hap_b"), average.alias("average"), times.alias("times"))
    a, b = sample_of("hap_a"), sample_of("hap_b")
    # Of an individual with itself the pair of two haplotypes counts in both orders.
    times = F.when(a == b, 2).otherwise(1)
    cells = matrix.select(F.explode(F.array(one("hap_a", "hap_b", F.col("average"), times), one("hap_a", "hap_a", F.lit(1.0), F.lit(1)), one("hap_b", "hap_b", F.lit(1.0), F.lit(1)))).alias("c")).select("c.*")
    rows = cells.groupBy("hap_a", "hap_b").agg(F.max("average").alias("average"), F.max("times").alias("times"))
    return rows.groupBy(F.least(a, b).alias("individual_a"), F.greatest(a, b).alias("individual_b")).agg((F.sum(F.col("average") * F.col("times")) / F.sum("times")).alias("average"), F.sum("times").cast("long").alias("n"))


def double_centered(matrix: DataFrame) -> DataFrame:
    """x - row mean - column mean + grand mean of a symmetric matrix in long form. Each entry
    goes to both of its rows, where it meets their means, and comes back as one."""
    ways = F.when(F.col("individual_a") == F.col("individual_b"), F.array(F.struct(F.col("individual_a").alias("i")))).otherwise(F.array(F.struct(F.col("individual_a").alias("i")), F.struct(F.col("individual_b").alias("i"))))
    full = matrix.withColumn("_i", F.explode(ways)).withColumn("_i", F.col("_i.i"))
    mean = F.avg("average").over(Window.partitionBy("_i"))
    met = full.withColumn("_m", mean).groupBy(*matrix.columns).agg(F.max(F.when(F.col("_i") == F.col("individual_a"), F.col("_m"))).alias("_a"), F.max(F.when(F.col("_i") == F.col("individual_b"), F.col("_m"))).alias("_b"))
    twice = F.when(F.col("individual_a") == F.col("individual_b"), 1).otherwise(2)
    grand = matrix.agg(F.sum(F.col("average") * twice) / F.sum(twice)).scalar()
    return met.withColumn("centered", F.col("average") - F.col("_a") - F.col("_b") + grand).drop("_a", "_b")
