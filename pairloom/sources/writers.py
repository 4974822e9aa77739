"""Sinks: tables with the tools' headers and number formats, BED, matrices, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.columns import sample_of

#: Columns of the output tables, with printf formats.
SEGMENTS = (("chrom", "chrom", "%s"), ("start", "start_bp", "%d"), ("end", "end_bp", "%d"), ("group.a", "hap_a", "%s"), ("group.b", "hap_b", "%s"), ("n_windows", "n_windows", "%d"), ("mean_identity", "mean_identity", "%.6f"), ("mean_posterior", "mean_posterior", "%.4f"), ("min_posterior", "min_posterior", "%.4f"), ("max_posterior", "max_posterior", "%.4f"), ("lod_score", "lod_score", "%.2f"))
PAINTING = (("chrom", "chrom", "%s"), ("start", "start_bp", "%d"), ("end", "end_bp", "%d"), ("sample", "sample", "%s"), ("ancestry", "ancestry", "%s"), ("n_windows", "n_windows", "%d"), ("mean_similarity", "mean_similarity", "%.6f"), ("mean_posterior", "mean_posterior", "%.6f"), ("discriminability", "discriminability", "%.6f"), ("lod_score", "lod_score", "%.4f"))
ENRICHMENT = (("chrom", "chrom", "%s"), ("start", "start_bp", "%d"), ("end", "end_bp", "%d"), ("n_pairs", "n_pairs", "%d"), ("n_ibs", "n_ibs", "%d"), ("frac_ibs", "frac_ibs", "%.6f"))
POSTERIORS = (("chrom", "chrom", "%s"), ("start", "start_bp", "%d"), ("end", "end_bp", "%d"), ("group.a", "hap_a", "%s"), ("group.b", "hap_b", "%s"), ("identity", "identity", "%.6f"), ("posterior", "posterior", "%.6f"))
TIMING = tuple((c, c, f) for c, f in (("sample", "%s"), ("population", "%s"), ("n_tracts", "%d"), ("n_pulses", "%d"), ("pulse_idx", "%d"), ("generations", "%.2f"), ("proportion", "%.6f"), ("rate", "%.6e"), ("bic", "%.4f"), ("log_likelihood", "%.4f"), ("ks_statistic", "%.6f"), ("ks_rejected", "%s")))


def table(df: DataFrame, columns, path: str, missing: str = "NA") -> None:
    """Tab-separated files with a header, each number in its column's format."""
    cell = lambda name, fmt: F.coalesce(F.format_string(fmt, F.col(name)), F.lit(missing)) if fmt != "%s" else F.coalesce(F.col(name).cast("string"), F.lit(missing))
    shown = df.select(*[F.when(F.col(name).isNull(), F.lit(missing)).otherwise(cell(name, fmt)).alias(head) for head, name, fmt in columns])
    shown.write.csv(path, sep="\t", header=True, quote="")


def segment_bed(segments: DataFrame) -> DataFrame:
    """BED6 lines: 0-based start, both haplotypes as the name, 100 x LOD up to 1000 as score."""
    score = F.least(F.lit(1000), F.round(100 * F.greatest(F.col("lod_score"), F.lit(0.0))).cast("int"))
    return segments.select(F.concat_ws("\t", "chrom", (F.col("start_bp") - 1).cast("string"), F.col("end_bp").cast("string"), F.concat_ws("_", "hap_a", "hap_b"), score.cast("string"), F.lit(".")).alias("value"))


class _Out:
    """A file of any Hadoop file system, written from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def write(self, data: bytes) -> None:
        self.stream.write(bytearray(data))

    def close(self) -> None:
        self.stream.close()


def matrix_files(matrix: DataFrame, prefix: str, center: bool = False, ids: tuple[str, str] = ("hap_a", "hap_b")) -> list[str]:
    """The binary triple of a relationship matrix: lower triangle of averages and of counts as
    little-endian 32-bit floats, and an id list; 0 without data. The format wants one file
    in row order, so entries are sorted where they are and pass the driver row by row,
    which holds the names and one row of the triangle."""
    spark, (a, b) = matrix.sparkSession, ids
    names = [r.x for r in matrix.select(F.explode(F.array(a, b)).alias("x")).distinct().orderBy("x").collect()]
    if not names:
        raise ValueError("no samples for a matrix")
    at = {h: k for k, h in enumerate(names)}
    mean = matrix.agg(F.avg("average")).first()[0] if center else 0.0
    rows = matrix.select(F.greatest(a, b).alias("i"), F.least(a, b).alias("j"), "average", "n").orderBy("i", "j").toLocalIterator()
    values, counts = _Out(spark, f"{prefix}.grm.bin"), _Out(spark, f"{prefix}.grm.N.bin")
    r = next(rows, None)
    for k, name in enumerate(names):
        value, count = np.full(k + 1, -mean), np.zeros(k + 1)
        while r is not None and r.i == name:
            value[at[r.j]], count[at[r.j]] = r.average - mean, r.n
            r = next(rows, None)
        values.write(value.astype("<f4").tobytes())
        counts.write(count.astype("<f4").tobytes())
    out = _Out(spark, f"{prefix}.grm.id")
    out.write("".join(f"{h.split('#')[0]}\t{h}\n" for h in names).encode())
    for f in (values, counts, out):
        f.close()
    return names


def diploid_files(matrix: DataFrame, prefix: str, center: bool = False) -> list[str]:
    """The same triple of the individuals' matrix."""
    return matrix_files(matrix, prefix, center, ("individual_a", "individual_b"))


def class_report(metrics: DataFrame) -> str:
    """Precision, recall and F1 by class as text."""
    lines = [f"{'class':<12}{'precision':>10}{'recall':>10}{'f1':>10}"]
    lines += [f"{r['class']:<12}{r.precision:>10.4f}{r.recall:>10.4f}{r.f1:>10.4f}" for r in metrics.orderBy("class").collect()]
    return "\n".join(lines)


def individuals(matrix: DataFrame) -> DataFrame:
    """The individuals of a haplotype matrix."""
    return matrix.select(F.explode(F.array(sample_of("hap_a"), sample_of("hap_b"))).alias("individual")).distinct()
