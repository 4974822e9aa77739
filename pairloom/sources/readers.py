"""Readers: similarity tables, interval files, lists, maps, gold standards, parameters."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("chrom", "start", "end", "group.a", "group.b")


def similarity_table(spark: SparkSession, path: str, column: str = "estimated.identity", strict: bool = False) -> DataFrame:
    """A tab-separated table with a header; columns are found by name, in any order:
    chrom, start, end, group.a, group.b, the similarity column and, if there, both
    lengths. Rows whose numbers do not parse are dropped, or are an error if strict."""
    raw = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in (*REQUIRED, column) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns not found in {path}: {', '.join(missing)}")
    get = lambda name, kind: F.col(f"`{name}`").cast(kind) if strict else F.col(f"`{name}`").try_cast(kind)
    cols = [F.col("chrom"), get("start", "long").alias("start_bp"), get("end", "long").alias("end_bp"), F.col("`group.a`").alias("group_a"), F.col("`group.b`").alias("group_b"), get(column, "double").alias("identity")]
    for side in "ab":
        if f"group.{side}.length" in raw.columns:
            cols.append(F.coalesce(F.col(f"`group.{side}.length`").try_cast("long"), F.lit(0)).alias(f"{side}_length"))
    return raw.select(*cols).dropna(subset=["start_bp", "end_bp", "identity"])


def positional_table(spark: SparkSession, path: str) -> DataFrame:
    """Five or more tab-separated columns by position: chrom, start, end and two names, with
    or without a header. Positions that are not numbers are an error."""
    parts = spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", "\t").alias("p")).filter(F.lower(F.get("p", F.lit(0))) != "chrom")
    return parts.select(F.get("p", F.lit(0)).alias("chrom"), F.get("p", F.lit(1)).cast("long").alias("start_bp"), F.get("p", F.lit(2)).cast("long").alias("end_bp"), F.get("p", F.lit(3)).alias("group_a"), F.get("p", F.lit(4)).alias("group_b"))


def bed(spark: SparkSession, path: str, shift: int = 1, lenient: bool = False) -> DataFrame:
    """chrom, start_bp, end_bp of a BED file; starts move by `shift` to 1-based ones. Lines
    of under three fields and bad numbers are errors; lenient: skipped, and 0."""
    parts = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')").select("v", F.split("v", r"\s+").alias("p"))
    if lenient:
        parts = parts.filter("size(p) >= 3")
        number = lambda k: F.coalesce(F.get("p", F.lit(k)).try_cast("long"), F.lit(0))
    else:
        parts = parts.withColumn("p", F.when(F.size("p") >= 3, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a BED line: "), F.col("v")))))
        number = lambda k: F.get("p", F.lit(k)).cast("long")
    return parts.select(F.get("p", F.lit(0)).alias("chrom"), (number(1) + shift).alias("start_bp"), number(2).alias("end_bp"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed; blank lines and # comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> '' and not startswith(id, '#')").distinct()


def populations(spark: SparkSession, path: str) -> DataFrame:
    """population, haplotype of a two-column file."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) >= 2 and not startswith(p[0], '#')")
    return parts.select(F.col("p")[0].alias("population"), F.col("p")[1].alias("haplotype"))


def populations_folder(spark: SparkSession, path: str) -> DataFrame:
    """population (the file's stem) and sample of a folder of .txt lists."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("population"), F.trim("value").alias("sample"))
    return lines.filter("sample <> '' and not startswith(sample, '#')")


def genetic_map(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """chrom, bp, cm of a map with four columns (chrom, bp, rate, cM; of one chromosome) or three
    (bp, rate, cM); lines that are neither are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    plain = lambda c: F.regexp_replace(c, "^chr", "")
    own = (F.size("p") == 3) | ((F.size("p") >= 4) & (plain(F.get("p", F.lit(0))) == re.sub("^chr", "", chrom)))
    at = F.when(F.size("p") >= 4, 1).otherwise(0)
    return parts.filter(own).select(F.lit(chrom).alias("chrom"), F.get("p", at).try_cast("long").alias("bp"), F.get("p", at + 2).try_cast("double").alias("cm")).dropna()


def gold_segments(spark: SparkSession, path: str) -> DataFrame:
    """Shared segments of a phased caller: two samples with haplotype numbers, chromosome,
    interval, score. Lines that do not parse are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    get = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    rows = spark.read.text(path).filter("not startswith(trim(value), '#')").select(p.alias("p")).filter("size(p) >= 8")
    return rows.select(get(0, "string").alias("sample1"), get(1, "int").alias("hap1"), get(2, "string").alias("sample2"), get(3, "int").alias("hap2"), get(4, "string").alias("chrom"), get(5, "long").alias("start_bp"), get(6, "long").alias("end_bp"), get(7, "double").alias("lod")).dropna()


def painting_header(line: str) -> list[str]:
    """Population names of `#...: NAME=0 NAME=1` or `#...: NAME NAME`."""
    if not line.startswith("#") or ":" not in line:
        raise ValueError(f"not a population header: {line}")
    fields = line.split(":", 1)[1].split()
    numbered = sorted((int(i), n) for n, _, i in (f.partition("=") for f in fields if "=" in f))
    if not numbered:
        if not fields:
            raise ValueError("no populations in the header")
        return fields
    if [i for i, _ in numbered] != list(range(len(numbered))):
        raise ValueError("population numbers have gaps")
    return [n for _, n in numbered]


def gold_painting(spark: SparkSession, path: str) -> DataFrame:
    """A painting in wide form (two header lines, six columns, one number a haplotype) as
    long rows: chrom, start_bp, end_bp, haplotype, state, population."""
    head = [r.value for r in spark.read.text(path).limit(2).collect()]
    names, haps = painting_header(head[0].strip()), head[1].strip().lstrip("#").split("\t")[6:]
    p = spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("p")).filter(F.get("p", F.lit(1)).try_cast("long").isNotNull())
    wide = p.select(F.get("p", F.lit(0)).alias("chrom"), F.get("p", F.lit(1)).cast("long").alias("start_bp"), F.get("p", F.lit(2)).cast("long").alias("end_bp"), F.slice("p", 7, len(haps)).alias("calls"))
    long = wide.select("chrom", "start_bp", "end_bp", F.posexplode("calls").alias("k", "call")).withColumn("state", F.col("call").cast("int"))
    return long.select("chrom", "start_bp", "end_bp", F.get(F.array(*map(F.lit, haps)), F.col("k")).alias("haplotype"), "state", F.get(F.array(*map(F.lit, names)), F.col("state")).alias("population"))


@dataclass
class LearnedParameters:
    """Parameters of the painting model as they are saved."""

    population_names: list[str]
    temperature: float
    switch_prob: float
    version: int = 1
    pairwise_weight: float = 0.0
    emission_context: int = 0
    identity_floor: float = 0.0
    transition_dampening: float = 0.0
    transitions: list[list[float]] | None = None
    initial_probs: list[float] | None = None
    source: str | None = field(default=None)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({k: v for k, v in self.__dict__.items() if v is not None}, indent=2))

    @classmethod
    def load(cls, path: str) -> LearnedParameters:
        data = json.loads(Path(path).read_text())
        if data.get("version", 1) > 1:
            raise ValueError(f"parameters of a newer version: {data['version']}")
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})

    def reordered(self, names: list[str]) -> LearnedParameters:
        """For the same populations in another order; an error for other ones."""
        if sorted(names) != sorted(self.population_names):
            raise ValueError(f"populations differ: {sorted(self.population_names)} and {sorted(names)}")
        at = [self.population_names.index(n) for n in names]
        t, p = self.transitions, self.initial_probs
        return LearnedParameters(**self.__dict__ | {"population_names": list(names), "transitions": t and [[t[i][j] for j in at] for i in at], "initial_probs": p and [p[i] for i in at]})
