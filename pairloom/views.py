"""Similarity and interval views over the driver's tables, and the same views in DuckDB SQL.

Every row of lineitem becomes one row of a similarity table: a window (week of the
ship date) in which two haplotypes have an identity, high in some stretches of some
pairs and low elsewhere. The same rows give intervals for the interval operators, and
events give tracks. All values are rounded early, so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 10_000
HAPLOTYPES = 12
#: The haplotypes that play the references, by population.
POPULATIONS = {"EAST": ("S0#1", "S0#2", "S1#1"), "NORTH": ("S1#2", "S2#1"), "WEST": ("S2#2", "S3#1", "S3#2")}
QUERIES = ("S4#1", "S4#2", "S5#1", "S5#2")


def _hap(k: str) -> str:
    return f"concat('S', cast(cast(floor(({k}) / 2) as int) as string), '#', cast(({k}) % 2 + 1 as string))"


def _identity(week: str, a: str, b: str, line: str) -> str:
    high = f"(cast(floor({week} / 24) as int) * 7 + {a} * {a} + {b} * {b} + {line}) % 6 = 0"
    return f"round(case when {high} then cast('0.9996' as double) + cast('0.003' as double) * l_discount else cast('0.9975' as double) + cast('0.01' as double) * l_discount end, 9)"


_WEEK = {"spark": "cast(floor(datediff(l_shipdate, date '1992-01-01') / 7) as int)", "duckdb": "cast(floor(date_diff('day', timestamp '1992-01-01', l_shipdate) / 7) as int)"}


def raw_sql(dialect: str) -> str:
    """The similarity table as it would be read from a file, of all lineitem rows."""
    inner = f"select l_orderkey, l_linenumber, l_quantity, l_discount, l_suppkey % {HAPLOTYPES} as a, l_partkey % {HAPLOTYPES} as b, {_WEEK[dialect]} as w from lineitem"
    return f"""select concat('CHM13#0#chr', cast(l_linenumber as string)) as chrom, cast(w as bigint) * {WINDOW} + 1 as start_bp, (cast(w as bigint) + 1) * {WINDOW} as end_bp,
        concat({_hap('a')}, '#ctg') as group_a, concat({_hap('b')}, '#ctg') as group_b, {_identity('w', 'a', 'b', 'l_linenumber')} as identity,
        cast(l_quantity * 100 as bigint) as a_length, cast(l_orderkey % 5000 as bigint) as b_length from ({inner}) x"""


def raw_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(raw_sql("spark"))


#: One row per window and unordered pair of haplotypes: what the file loaders make of it.
SIM = f"""sim as (select concat('chr', split_part(chrom, 'chr', 2)) as chrom, start_bp, end_bp, least(ha, hb) as hap_a, greatest(ha, hb) as hap_b, max(identity) as identity,
    max(a_length) as a_length, max(b_length) as b_length
    from (select *, concat(split_part(group_a, '#', 1), '#', split_part(group_a, '#', 2)) as ha, concat(split_part(group_b, '#', 1), '#', split_part(group_b, '#', 2)) as hb from ({raw_sql('duckdb')}) r) q
    where ha <> hb group by 1, 2, 3, 4, 5)"""


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.operators.rows import best_per_window, load_pairs

    return best_per_window(load_pairs(raw_similarity(spark, sf_dir)))


_SEG = f"""select concat('chr', cast(l_linenumber as string)) as chrom, cast(l_orderkey as bigint) * 400 + cast(l_suppkey % 7 as bigint) * 30 as start_bp,
    cast(l_orderkey as bigint) * 400 + cast(l_suppkey % 7 as bigint) * 30 + cast(l_quantity * 20 as bigint) + 50 as end_bp,
    {_hap(f'l_suppkey % {HAPLOTYPES}')} as hap_a, {_hap(f'l_partkey % {HAPLOTYPES}')} as hap_b, l_returnflag, round(l_tax * 100, 3) as lod from lineitem"""
SEGMENTS = f"seg as ({_SEG}), ours as (select * from seg where l_returnflag <> 'N'), theirs as (select * from seg where l_returnflag = 'N')"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals with a pair, a score and a class; ours and theirs split by class."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(_SEG)


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).filter("l_returnflag <> 'N'")


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).filter("l_returnflag = 'N'")


_TRACK = "select user_id as sample, event_id as pos, {state} as state, round(value, 6) as value from events"
_STATE = "case when value < 6 then 0 when value < 15 then 1 else 2 end"
TRACK = f"track as ({_TRACK.format(state=_STATE)})"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user an ordered track of states 0 to 2 and values, from all events."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(_TRACK.format(state=_STATE))


def populations(spark: SparkSession) -> DataFrame:
    """population, haplotype."""
    return spark.createDataFrame([(p, h) for p, hs in POPULATIONS.items() for h in hs], "population string, haplotype string")


POPULATIONS_SQL = "pops(population, haplotype) as (values " + ", ".join(f"('{p}', '{h}')" for p, hs in POPULATIONS.items() for h in hs) + ")"
_MAP = [(0, 0.0), (500_000, 0.4), (1_500_000, 1.9), (3_000_000, 2.2)]
_CHROMOSOMES = range(1, 8)
_MAPS = [(f"chr{c}", b, round(cm * (1 + c / 10), 6)) for c in _CHROMOSOMES for b, cm in _MAP]
GENETIC_MAP = "gmap(chrom, bp, cm) as (values " + ", ".join(f"('{c}', {b}::bigint, {cm}::double)" for c, b, cm in _MAPS) + ")"


def genetic_map(spark: SparkSession) -> DataFrame:
    """chrom, bp, cm."""
    return spark.createDataFrame(_MAPS, "chrom string, bp long, cm double")
