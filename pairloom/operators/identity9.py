"""Nine identity classes of two individuals' four haplotypes at each locus."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(edges: set[tuple[int, int]]) -> int | None:
    """The class of a partition of a1, a2, b1, b2 (numbers 0 to 3) by its connected parts."""
    part = list(range(4))
    for a, b in sorted(edges):
        part = [part[a] if p == part[b] else p for p in part]
    a, b = part[0] == part[1], part[2] == part[3]
    across = sum(part[i] == part[j] for i in (0, 1) for j in (2, 3))
    if a and b:
        return 1 if across else 2
    if a:
        return 3 if across else 4
    if b:
        return 5 if across else 6
    return {0: 9, 1: 8, 2: 7}.get(across)


def class_table() -> list[tuple[int, int]]:
    """(mask, class) of the 64 sets of edges; bit k is the k-th pair of 0 to 3."""
    pairs = list(combinations(range(4), 2))
    return [(m, c) for m in range(64) if (c := classify({p for k, p in enumerate(pairs) if m >> k & 1})) is not None]


def identity_classes(pairs: DataFrame, haplotypes: tuple[str, str, str, str]) -> DataFrame:
    """delta, n and proportion: loci (chromosome, start, end) of each class over rows whose
    presence means identity. Windows of the whole span of the table that are no such locus
    count as class 9; loci without a class are left out, of the shares too. Haplotypes
    must differ, and windows must not end before they start; an empty table gives no rows.

    One pass: rows to loci, loci to their 64 masks, these to nine counts."""
    if len(set(haplotypes)) != 4:
        raise ValueError(f"haplotypes must be distinct: {haplotypes}")
    number = F.create_map(*[x for k, h in enumerate(haplotypes) for x in (F.lit(h), F.lit(k))])
    a, b = F.try_element_at(number, F.col("hap_a")), F.try_element_at(number, F.col("hap_b"))
    code = F.create_map(*[x for k, (i, j) in enumerate(combinations(range(4), 2)) for x in (F.lit(i * 4 + j), F.lit(1 << k))])
    end = F.when(F.col("end_bp") < F.col("start_bp"), F.raise_error(F.lit("a window ends before it starts")).cast("long")).otherwise(F.col("end_bp"))
    bits = pairs.select("chrom", "start_bp", end.alias("end_bp"), F.try_element_at(code, F.least(a, b) * 4 + F.greatest(a, b)).alias("bit"))
    loci = bits.groupBy("chrom", "start_bp", "end_bp").agg(F.bit_or("bit").alias("mask"))
    masks = loci.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.min("start_bp").alias("lo"), F.max("end_bp").alias("hi"), F.min(F.struct("start_bp", "end_bp")).alias("first"))
    delta_of = dict(class_table())
    delta = F.get(F.array(*[F.lit(delta_of.get(m)).cast("int") for m in range(64)]), F.col("mask"))
    whole = masks.agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.sum(F.when(F.col("mask").isNotNull(), F.col("n"))).alias("seen"),
        F.collect_list(F.when(F.col("mask").isNotNull(), F.struct(delta.alias("delta"), "n"))).alias("classes"),
    )
    windows = F.floor((F.col("hi") - F.col("lo") + 1) / (F.col("first.end_bp") - F.col("first.start_bp") + 1)).cast("long")
    missing = F.struct(F.lit(9).alias("delta"), F.greatest(F.lit(0).cast("long"), windows - F.coalesce("seen", F.lit(0))).alias("n"))
    rows = whole.select(F.explode(F.concat("classes", F.array(missing))).alias("c")).select("c.*").filter("delta is not null")
    total = rows.groupBy("delta").agg(F.sum("n").alias("n")).filter("n > 0")
    return total.select("delta", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("proportion"))
