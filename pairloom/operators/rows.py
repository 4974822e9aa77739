"""Row-level operators: loading rules, filters, masks, sample sets and tiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.columns import haplotype_of, sample_of, short_chrom


def load_pairs(raw: DataFrame, contigs: bool = False) -> DataFrame:
    """The loader's rules: plain chromosome names, haplotype ids (or full contigs),
    unordered pairs, no pair of a haplotype with itself, no row without numbers."""
    a, b = (F.col("group_a"), F.col("group_b")) if contigs else (haplotype_of("group_a"), haplotype_of("group_b"))
    named = raw.select(short_chrom("chrom").alias("chrom"), "start_bp", "end_bp", F.least(a, b).alias("hap_a"), F.greatest(a, b).alias("hap_b"), "identity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a_length", "b_length") if c in raw.columns])
    return named.filter("hap_a <> hap_b and start_bp is not null and end_bp is not null and identity is not null")


def best_per_window(pairs: DataFrame) -> DataFrame:
    """One row per window and pair: the highest identity."""
    extra = [F.max(c).alias(c) for c in ("a_length", "b_length") if c in pairs.columns]
    return pairs.groupBy("chrom", "start_bp", "end_bp", "hap_a", "hap_b").agg(F.max("identity").alias("identity"), *extra)


def identical_windows(raw: DataFrame, cutoff: float = 0.999, reference: str | None = None) -> DataFrame:
    """Rows of the similarity tool's output that count: at least the cutoff, two different
    sequences in order, none of the reference."""
    kept = raw.filter((F.col("identity") >= cutoff) & (F.col("group_a") < F.col("group_b")))
    if reference:
        kept = kept.filter(~F.col("group_a").startswith(reference) & ~F.col("group_b").startswith(reference))
    return kept


def in_sample_sets(pairs: DataFrame, query: list[str] | None, reference: list[str] | None = None) -> DataFrame:
    """With a query set, one side must be in it; with a reference set too, the other side
    must be in that."""
    if query is None:
        return pairs
    a, b = sample_of("hap_a"), sample_of("hap_b")
    if reference is None:
        return pairs.filter(a.isin(query) | b.isin(query))
    return pairs.filter((a.isin(query) & b.isin(reference)) | (b.isin(query) & a.isin(reference)))


def bins(start, end, size: int):
    """All bins of a size that a half-open interval touches, as rows."""
    return F.explode(F.sequence(F.floor(start / size).cast("long"), F.floor(F.greatest(start, end - 1) / size).cast("long")))


def mask_out(rows: DataFrame, mask: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Rows (chrom, start_bp, end_bp) that overlap no mask interval: start < mask end and
    end > mask start. Both sides are cut into bins, so the test is an equi join."""
    cut = mask.select(F.col("chrom").alias("m_chrom"), F.col("start_bp").alias("m_start"), F.col("end_bp").alias("m_end"), bins(F.col("start_bp"), F.col("end_bp") + 1, size).alias("m_bin"))
    keyed = rows.select("chrom", "start_bp", "end_bp").distinct().withColumn("bin", bins(F.col("start_bp"), F.col("end_bp") + 1, size))
    hit = keyed.join(cut, (F.col("chrom") == F.col("m_chrom")) & (F.col("bin") == F.col("m_bin")) & (F.col("start_bp") < F.col("m_end")) & (F.col("end_bp") > F.col("m_start")))
    return rows.join(hit.select("chrom", "start_bp", "end_bp").distinct(), ["chrom", "start_bp", "end_bp"], "left_anti")


def tile(regions: DataFrame, size: int) -> DataFrame:
    """Windows of a size over 1-based inclusive regions, the last one truncated."""
    starts = F.explode(F.sequence(F.col("start_bp"), F.col("end_bp"), F.lit(size).cast("long")))
    return regions.withColumn("window_start", starts).withColumn("window_end", F.least(F.col("window_start") + size - 1, F.col("end_bp")))


def parse_region(text, length: int | None = None):
    """chrom, start, end of chrom:start-end, or of a bare chrom with the region's length;
    an error for what is neither, for a start below 1 and for an end before the start."""
    c = F.col(text) if isinstance(text, str) else text
    part = lambda k: F.nullif(F.regexp_extract(c, r"^(.+):(\d+)-(\d+)$", k), F.lit(""))
    start, end = part(2).cast("long"), part(3).cast("long")
    whole = F.struct(c.alias("chrom"), F.lit(1).cast("long").alias("start_bp"), F.lit(length).cast("long").alias("end_bp")) if length else F.raise_error(F.concat(F.lit("no coordinates in region "), c))
    good = F.struct(part(1).alias("chrom"), start.alias("start_bp"), end.alias("end_bp"))
    return F.when(part(2).isNull(), whole).when((start < 1) | (start > end), F.raise_error(F.concat(F.lit("bad coordinates in region "), c))).otherwise(good)


def query_reference(pairs: DataFrame, queries: list[str], references: DataFrame) -> DataFrame:
    """Rows with one side a query and the other a reference haplotype, in long form:
    sample, chrom, start_bp, end_bp, population, haplotype, identity (the highest)."""
    q = lambda c: F.col(c).isin(queries)
    sides = pairs.filter(q("hap_a") | q("hap_b")).select(
        "chrom", "start_bp", "end_bp", "identity",
        F.explode(F.array(F.struct(F.col("hap_a").alias("sample"), F.col("hap_b").alias("haplotype")), F.struct(F.col("hap_b").alias("sample"), F.col("hap_a").alias("haplotype")))).alias("s"),
    ).select("chrom", "start_bp", "end_bp", "identity", "s.*").filter(q("sample"))
    return sides.join(references, "haplotype").groupBy("sample", "chrom", "start_bp", "end_bp", "population", "haplotype").agg(F.max("identity").alias("identity"))
