"""Registry of the engine's queries and of the SQL that DuckDB runs beside them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairloom import views as V
from pairloom.functions import columns as C
from pairloom.operators import aggregates as A
from pairloom.operators import emissions as E
from pairloom.operators import genmap as G
from pairloom.operators import identity9, relate
from pairloom.operators import intervals as I
from pairloom.operators import islands as L
from pairloom.operators import rows as R
from pairloom.registry import ORACLE, QUERIES, query

PAIR = ["hap_a", "hap_b"]
GENOME = 30_000_000_000


def _sim(sql: str) -> str:
    return f"WITH {V.SIM} {sql}"


# Rows.


@query(_sim("SELECT chrom, start_bp, end_bp, count(*) AS n_pairs, count(*) FILTER (identity >= 0.999) AS n_ibs, round(count(*) FILTER (identity >= 0.999) / count(*)::double, 6) AS frac_ibs FROM sim GROUP BY 1, 2, 3"))
def ibs_enrichment(spark, sf_dir):
    return A.enrichment(V.similarity(spark, sf_dir))


@query(_sim("SELECT * FROM sim"))
def pair_canonical(spark, sf_dir):
    return V.similarity(spark, sf_dir)


@query(f"SELECT chrom, start_bp, end_bp, group_a, group_b, identity FROM ({V.raw_sql('duckdb')}) WHERE identity >= 0.999 AND group_a < group_b AND NOT starts_with(group_a, 'S0') AND NOT starts_with(group_b, 'S0')")
def identical_windows(spark, sf_dir):
    return R.identical_windows(V.raw_similarity(spark, sf_dir), 0.999, "S0").select("chrom", "start_bp", "end_bp", "group_a", "group_b", "identity")


@query(_sim("SELECT hap_a, hap_b, split_part(hap_a, '#', 1) AS sample_a, split_part(hap_b, '#', 1) AS sample_b, try_cast(split_part(hap_a, '#', 2) AS integer) AS index_a, count(*) AS n FROM sim GROUP BY ALL"))
def haplotype_ids(spark, sf_dir):
    s = V.similarity(spark, sf_dir)
    return s.select("hap_a", "hap_b", C.sample_of("hap_a").alias("sample_a"), C.sample_of("hap_b").alias("sample_b"), C.haplotype_index("hap_a").alias("index_a")).groupBy("hap_a", "hap_b", "sample_a", "sample_b", "index_a").agg(F.count(F.lit(1)).alias("n"))


@query(_sim("SELECT chrom, start_bp, hap_a, hap_b FROM sim WHERE split_part(hap_a, '#', 1) IN ('S0', 'S1') AND split_part(hap_b, '#', 1) IN ('S2', 'S3') OR split_part(hap_b, '#', 1) IN ('S0', 'S1') AND split_part(hap_a, '#', 1) IN ('S2', 'S3')"))
def sample_filter(spark, sf_dir):
    return R.in_sample_sets(V.similarity(spark, sf_dir), ["S0", "S1"], ["S2", "S3"]).select("chrom", "start_bp", "hap_a", "hap_b")


@query(f"WITH {V.SIM}, mask AS (SELECT concat('chr', l_linenumber) AS chrom, min(l_orderkey) * 12007 % 3500000 + 1 AS s, min(l_orderkey) * 12007 % 3500000 + 3000 AS e FROM lineitem GROUP BY l_linenumber, l_suppkey) SELECT chrom, start_bp, end_bp, hap_a, hap_b FROM sim WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.chrom = sim.chrom AND sim.start_bp < m.e AND sim.end_bp > m.s)")
def mask_filter(spark, sf_dir):
    s = V.similarity(spark, sf_dir)
    mask = spark.sql("SELECT concat('chr', cast(l_linenumber AS string)) AS chrom, min(l_orderkey) * 12007 % 3500000 + 1 AS start_bp, min(l_orderkey) * 12007 % 3500000 + 3000 AS end_bp FROM lineitem GROUP BY l_linenumber, l_suppkey")
    return R.mask_out(s, mask).select("chrom", "start_bp", "end_bp", "hap_a", "hap_b")


@query(f"WITH {V.SEGMENTS}, reg AS (SELECT chrom, hap_a, min(start_bp) + 1 AS s, max(end_bp) AS e FROM seg GROUP BY 1, 2) SELECT chrom, hap_a, w AS window_start, least(w + 99999, e) AS window_end FROM reg, unnest(range(s, e + 1, 100000)) t(w)")
def region_tiling(spark, sf_dir):
    regions = V.segments(spark, sf_dir).groupBy("chrom", "hap_a").agg((F.min("start_bp") + 1).alias("start_bp"), F.max("end_bp").alias("end_bp"))
    return R.tile(regions, 100_000).select("chrom", "hap_a", "window_start", "window_end")


@query(f"WITH {V.SEGMENTS} SELECT concat(chrom, ':', start_bp + 1, '-', end_bp) AS region, chrom, start_bp + 1 AS start_bp, end_bp FROM seg")
def region_parse(spark, sf_dir):
    text = V.segments(spark, sf_dir).select(F.concat(F.col("chrom"), F.lit(":"), (F.col("start_bp") + 1).cast("string"), F.lit("-"), F.col("end_bp").cast("string")).alias("region"))
    return text.select("region", R.parse_region("region").alias("r")).select("region", "r.chrom", "r.start_bp", "r.end_bp")


_QR = f"""WITH {V.SIM}, {V.POPULATIONS_SQL}, q(s) AS (VALUES {", ".join(f"('{x}')" for x in V.QUERIES)}),
    sides AS (SELECT *, hap_a AS sample, hap_b AS hap FROM sim UNION ALL SELECT *, hap_b, hap_a FROM sim),
    qr AS (SELECT sample, chrom, start_bp, end_bp, population, hap AS haplotype, max(identity) AS identity FROM sides JOIN q ON sample = s JOIN pops ON hap = pops.haplotype GROUP BY 1, 2, 3, 4, 5, 6)"""


@query(f"{_QR} SELECT * FROM qr")
def paint_pivot(spark, sf_dir):
    return R.query_reference(V.similarity(spark, sf_dir), list(V.QUERIES), V.populations(spark))


# Scalars.


@query(_sim("SELECT chrom, start_bp, hap_a, hap_b, round(CASE WHEN greatest(a_length, b_length) <= 0 THEN 0 ELSE least(a_length, b_length) / greatest(a_length, b_length)::double END, 9) AS coverage FROM sim"))
def coverage_ratio(spark, sf_dir):
    return V.similarity(spark, sf_dir).select("chrom", "start_bp", "hap_a", "hap_b", F.round(C.coverage_ratio("a_length", "b_length"), 9).alias("coverage"))


@query(_sim("SELECT chrom, start_bp, hap_a, hap_b, round(least(12, greatest(-12, ln(least(1 - 1e-10, greatest(1e-10, identity)) / (1 - least(1 - 1e-10, greatest(1e-10, identity)))))), 7) AS logit FROM sim"))
def logit(spark, sf_dir):
    return V.similarity(spark, sf_dir).select("chrom", "start_bp", "hap_a", "hap_b", F.round(C.logit("identity"), 7).alias("logit"))


_SHARED, _BACK = (0.9997, 0.0005), (0.999, math.sqrt(3 * 0.001 / 10_000))
_LOD = f"((-0.5 * ((identity - {_SHARED[0]}) / {_SHARED[1]}) * ((identity - {_SHARED[0]}) / {_SHARED[1]}) - ln({_SHARED[1]})) - (-0.5 * ((identity - {_BACK[0]}) / {_BACK[1]!r}::double) * ((identity - {_BACK[0]}) / {_BACK[1]!r}::double) - ln({_BACK[1]!r}::double))) / ln(10)"


@query(_sim(f"SELECT chrom, start_bp, hap_a, hap_b, round({_LOD}, 6) AS lod FROM sim"))
def window_lod(spark, sf_dir):
    return V.similarity(spark, sf_dir).select("chrom", "start_bp", "hap_a", "hap_b", F.round(C.window_lod("identity", _SHARED, _BACK), 6).alias("lod"))


# Aggregates.


@query(_sim("""SELECT chrom, start_bp, hap_a, hap_b, round(least(1, greatest(0, identity - (ba - mu) - (bb - mu))), 9) AS adjusted FROM sim
    JOIN (SELECT chrom, start_bp, avg(identity) AS mu FROM sim GROUP BY 1, 2) m USING (chrom, start_bp)
    JOIN (SELECT chrom, start_bp, h AS hap_a, avg(identity) AS ba FROM (SELECT chrom, start_bp, identity, unnest([hap_a, hap_b]) AS h FROM sim) GROUP BY 1, 2, 3) x USING (chrom, start_bp, hap_a)
    JOIN (SELECT chrom, start_bp, h AS hap_b, avg(identity) AS bb FROM (SELECT chrom, start_bp, identity, unnest([hap_a, hap_b]) AS h FROM sim) GROUP BY 1, 2, 3) y USING (chrom, start_bp, hap_b)"""))
def contrast_adjust(spark, sf_dir):
    return A.contrast_adjust(V.similarity(spark, sf_dir)).select("chrom", "start_bp", "hap_a", "hap_b", F.round("adjusted", 9).alias("adjusted"))


_BG = "SELECT chrom, start_bp, end_bp, count(*) FILTER (identity >= 0.999) AS n_high, count(*) AS n, avg(identity) AS mean, stddev_pop(identity) AS std FROM sim GROUP BY 1, 2, 3"


@query(_sim(f"SELECT chrom, start_bp, end_bp, n_high, n, round(mean, 9) AS mean, round(std, 9) AS std FROM ({_BG})"))
def window_background(spark, sf_dir):
    return A.window_background(V.similarity(spark, sf_dir)).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(_sim(f"SELECT chrom, start_bp, end_bp, hap_a, hap_b, identity FROM sim JOIN ({_BG}) b USING (chrom, start_bp, end_bp) WHERE n_high / n::double <= 0.3"))
def background_filter(spark, sf_dir):
    return A.background_filter(V.similarity(spark, sf_dir), 0.999, 0.3).select("chrom", "start_bp", "end_bp", "hap_a", "hap_b", "identity")


@query(_sim(f"SELECT chrom, start_bp, hap_a, hap_b, round(CASE WHEN n > 1 AND std >= 1e-8 THEN 1 / (1 + exp(-(identity - mean) / std)) ELSE identity END, 5) AS normalized FROM sim JOIN ({_BG}) b USING (chrom, start_bp, end_bp)"))
def background_normalize(spark, sf_dir):
    return A.background_normalize(V.similarity(spark, sf_dir)).select("chrom", "start_bp", "hap_a", "hap_b", F.round("normalized", 5).alias("normalized"))


_EGRM = "egrm AS (SELECT hap_a, hap_b, avg(identity) AS average, count(*) AS n FROM sim GROUP BY 1, 2)"


@query(f"WITH {V.SIM}, {_EGRM} SELECT hap_a, hap_b, round(average, 9) AS average, n, round(average - avg(average) OVER (), 9) AS centered FROM egrm")
def egrm(spark, sf_dir):
    return relate.centered(relate.relationship(V.similarity(spark, sf_dir))).select("hap_a", "hap_b", F.round("average", 9).alias("average"), "n", F.round("centered", 9).alias("centered"))


_DIP = f"""{_EGRM}, haps AS (SELECT hap_a AS h FROM sim UNION SELECT hap_b FROM sim),
    cells AS (SELECT split_part(hap_a, '#', 1) AS a, split_part(hap_b, '#', 1) AS b, average, CASE WHEN split_part(hap_a, '#', 1) = split_part(hap_b, '#', 1) THEN 2 ELSE 1 END AS t FROM egrm
        UNION ALL SELECT split_part(h, '#', 1), split_part(h, '#', 1), 1.0, 1 FROM haps),
    dip AS (SELECT least(a, b) AS individual_a, greatest(a, b) AS individual_b, sum(average * t) / sum(t) AS average, sum(t)::bigint AS n FROM cells GROUP BY 1, 2)"""


@query(f"WITH {V.SIM}, {_DIP} SELECT individual_a, individual_b, round(average, 9) AS average, n FROM dip")
def egrm_diploid(spark, sf_dir):
    return relate.diploid(relate.relationship(V.similarity(spark, sf_dir))).withColumn("average", F.round("average", 9))


@query(f"""WITH {V.SIM}, {_DIP}, full_m AS (SELECT individual_a AS i, individual_b AS j, average FROM dip UNION ALL SELECT individual_b, individual_a, average FROM dip WHERE individual_a <> individual_b),
    m AS (SELECT i, avg(average) AS m FROM full_m GROUP BY 1) SELECT individual_a, individual_b, round(average - x.m - y.m + (SELECT avg(average) FROM full_m), 9) AS centered FROM dip JOIN m x ON x.i = individual_a JOIN m y ON y.i = individual_b""")
def egrm_double_centered(spark, sf_dir):
    return relate.double_centered(relate.diploid(relate.relationship(V.similarity(spark, sf_dir)))).select("individual_a", "individual_b", F.round("centered", 9).alias("centered"))


@query(f"WITH {V.SEGMENTS} SELECT least(split_part(hap_a, '#', 1), split_part(hap_b, '#', 1)) AS individual_a, greatest(split_part(hap_a, '#', 1), split_part(hap_b, '#', 1)) AS individual_b, sum(end_bp - start_bp)::bigint AS total_ibd_bp, round(sum(end_bp - start_bp)::bigint / {4.0 * GENOME}, 9) AS theta_hat FROM seg WHERE split_part(hap_a, '#', 1) <> split_part(hap_b, '#', 1) GROUP BY 1, 2")
def kinship(spark, sf_dir):
    return relate.kinship(V.segments(spark, sf_dir), GENOME)


@query(f"WITH {V.SEGMENTS} SELECT count(*) AS n, round(avg(end_bp - start_bp), 6) AS mean_len, round(median(end_bp - start_bp), 6) AS median_len, round(stddev_samp(end_bp - start_bp), 6) AS std_len, min(end_bp - start_bp) AS min_len, max(end_bp - start_bp) AS max_len, sum(end_bp - start_bp)::bigint AS total_len FROM seg")
def seg_length_stats(spark, sf_dir):
    return A.length_stats(V.segments(spark, sf_dir))


@query(f"WITH {V.SEGMENTS} SELECT (end_bp - start_bp) // 100 * 100 AS bin_start, count(*) AS n FROM seg GROUP BY 1")
def seg_histogram(spark, sf_dir):
    return A.length_histogram(V.segments(spark, sf_dir), 100)


@query(_sim("SELECT hap_a, hap_b, round(avg(identity), 9) AS trimmed_mean FROM (SELECT *, row_number() OVER (PARTITION BY hap_a, hap_b ORDER BY identity) AS r, count(*) OVER (PARTITION BY hap_a, hap_b) AS n FROM sim) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY 1, 2"))
def trimmed_mean(spark, sf_dir):
    return A.trimmed_mean(V.similarity(spark, sf_dir), PAIR, "identity", 0.1).withColumn("trimmed_mean", F.round("trimmed_mean", 9))


@query(_sim("SELECT hap_a, hap_b, round(least(0.002, greatest(0.0003, stddev_pop(identity))), 9) AS top_std FROM (SELECT *, row_number() OVER (PARTITION BY hap_a, hap_b ORDER BY identity DESC) AS r, count(*) OVER (PARTITION BY hap_a, hap_b) AS n FROM sim) WHERE n >= 20 AND r <= greatest(5, ceil(n * 0.05)) GROUP BY 1, 2"))
def top_share_std(spark, sf_dir):
    return A.top_share_std(V.similarity(spark, sf_dir), PAIR, "identity").withColumn("top_std", F.round("top_std", 9))


@query(_sim("SELECT chrom, hap_a, hap_b, block, round(avg(identity), 9) AS mean FROM (SELECT *, (row_number() OVER (PARTITION BY chrom, hap_a, hap_b ORDER BY start_bp) - 1) // 4 AS block FROM sim) GROUP BY 1, 2, 3, 4"))
def block_means(spark, sf_dir):
    return A.block_means(V.similarity(spark, sf_dir), ["chrom", *PAIR], "start_bp", "identity", 4).withColumn("mean", F.round("mean", 9))


_ISLAND = "(SELECT *, sum(new) OVER (PARTITION BY sample ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY sample ORDER BY pos) = state THEN 0 ELSE 1 END AS new FROM track))"


@query(f"""WITH {V.TRACK}, tracts AS (SELECT sample, state, min(pos) AS s, max(pos) + 1 AS e FROM {_ISLAND} GROUP BY sample, run, state),
    per AS (SELECT sample, concat('P', state) AS ancestry, sum(e - s)::bigint AS bp, count(*) AS n_tracts, round(avg(e - s), 6) AS mean_tract FROM tracts GROUP BY 1, 2),
    sw AS (SELECT sample, count(*) - 1 AS n_switches FROM tracts GROUP BY 1)
    SELECT sample, ancestry, bp, n_tracts, mean_tract, round(bp / sum(bp) OVER (PARTITION BY sample), 6) AS proportion, n_switches FROM per JOIN sw USING (sample)""")
def admixture(spark, sf_dir):
    runs = L.runs(V.track(spark, sf_dir), ["sample"], "pos", "state")
    return A.admixture(runs.select("sample", F.concat(F.lit("P"), F.col("state").cast("string")).alias("ancestry"), F.col("first_pos").alias("start_bp"), (F.col("last_pos") + 1).alias("end_bp")))


_CALLS = "calls AS (SELECT concat('P', state) AS truth, concat('P', CASE WHEN value < 7 THEN 0 WHEN value < 12 THEN 1 ELSE 3 END) AS called FROM track)"


def _calls(spark, sf_dir):
    t = V.track(spark, sf_dir)
    return t.select(F.concat(F.lit("P"), F.col("state").cast("string")).alias("truth"), F.concat(F.lit("P"), F.expr("cast(case when value < 7 then 0 when value < 12 then 1 else 3 end as string)")).alias("called"))


@query(f"WITH {V.TRACK}, {_CALLS}, l(label) AS (VALUES ('P0'), ('P1'), ('P2'), ('P3')) SELECT a.label AS true_pop, b.label AS called_pop, count(truth) AS n FROM l a CROSS JOIN l b LEFT JOIN calls ON truth = a.label AND called = b.label GROUP BY 1, 2")
def confusion(spark, sf_dir):
    labels = spark.createDataFrame([("P0",), ("P1",), ("P2",), ("P3",)], "label string")
    return A.confusion(_calls(spark, sf_dir), "truth", "called", labels)


@query(f"""WITH {V.TRACK}, {_CALLS}, c AS (SELECT DISTINCT truth AS class FROM calls UNION SELECT DISTINCT called FROM calls),
    s AS (SELECT class, (SELECT count(*) FROM calls WHERE truth = class) AS actual, (SELECT count(*) FROM calls WHERE called = class) AS called, (SELECT count(*) FROM calls WHERE truth = class AND called = class) AS hit FROM c),
    m AS (SELECT class, CASE WHEN called > 0 THEN hit / called::double ELSE 0 END AS p, CASE WHEN actual > 0 THEN hit / actual::double ELSE 0 END AS r FROM s)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def class_metrics(spark, sf_dir):
    return A.class_metrics(_calls(spark, sf_dir), "truth", "called")


# Intervals.

_KEYS = ["chrom", "hap_a", "hap_b"]
_K = "chrom, hap_a, hap_b"


def _merged(name: str, source: str) -> str:
    return f"""{name}_i AS (SELECT *, CASE WHEN start_bp <= max(end_bp) OVER (PARTITION BY {_K} ORDER BY start_bp, end_bp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {source} WHERE end_bp > start_bp),
    {name} AS (SELECT {_K}, min(start_bp) AS start_bp, max(end_bp) AS end_bp FROM (SELECT *, sum(new) OVER (PARTITION BY {_K} ORDER BY start_bp, end_bp ROWS UNBOUNDED PRECEDING) AS island FROM {name}_i) GROUP BY {_K}, island)"""


@query(f"WITH {V.SEGMENTS}, {_merged('m', 'seg')} SELECT * FROM m")
def interval_merge(spark, sf_dir):
    return I.merge_intervals(V.segments(spark, sf_dir), _KEYS)


@query(f"WITH {V.SEGMENTS}, clip AS (SELECT {_K}, greatest(start_bp, 1000000) AS start_bp, least(end_bp, 4000000) AS end_bp FROM seg), {_merged('m', 'clip')} SELECT {_K}, sum(end_bp - start_bp)::bigint AS bp FROM m GROUP BY ALL")
def covered_bp(spark, sf_dir):
    return I.covered(V.segments(spark, sf_dir), _KEYS, (1_000_000, 4_000_000))


_AGREE = f"""{V.SEGMENTS}, {_merged('a', 'ours')}, {_merged('b', 'theirs')},
    la AS (SELECT {_K}, sum(end_bp - start_bp)::bigint AS a_bp FROM a GROUP BY ALL), lb AS (SELECT {_K}, sum(end_bp - start_bp)::bigint AS b_bp FROM b GROUP BY ALL),
    lab AS (SELECT {_K}, sum(least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp))::bigint AS ab_bp FROM a JOIN b USING ({_K}) WHERE a.start_bp < b.end_bp AND b.start_bp < a.end_bp GROUP BY ALL),
    j AS (SELECT {_K}, coalesce(a_bp, 0) AS a_bp, coalesce(b_bp, 0) AS b_bp, coalesce(ab_bp, 0) AS ab_bp FROM la FULL JOIN lb USING ({_K}) LEFT JOIN lab USING ({_K}))"""


@query(f"WITH {_AGREE} SELECT {_K}, a_bp, b_bp, ab_bp, round(CASE WHEN a_bp + b_bp - ab_bp > 0 THEN ab_bp / (a_bp + b_bp - ab_bp)::double ELSE 0 END, 6) AS jaccard, round(CASE WHEN a_bp > 0 THEN ab_bp / a_bp::double ELSE 0 END, 6) AS precision, round(CASE WHEN b_bp > 0 THEN ab_bp / b_bp::double ELSE 0 END, 6) AS recall FROM j")
def interval_agreement(spark, sf_dir):
    return I.agreement(V.ours(spark, sf_dir), V.theirs(spark, sf_dir), _KEYS)


@query(f"WITH {V.SEGMENTS} SELECT {_K}, sum(least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp))::bigint AS bp FROM ours a JOIN theirs b USING ({_K}) WHERE a.start_bp < b.end_bp AND b.start_bp < a.end_bp GROUP BY ALL")
def intersection_unmerged(spark, sf_dir):
    return I.intersection(V.ours(spark, sf_dir), V.theirs(spark, sf_dir), _KEYS, merge=False)


_MATCHED = f"matched AS (SELECT chrom, a.start_bp, a.end_bp, b.start_bp AS b_start, b.end_bp AS b_end, least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp) AS overlap FROM ours a JOIN theirs b USING (chrom) WHERE a.start_bp < b.end_bp AND b.start_bp < a.end_bp AND (least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp)) / least(a.end_bp - a.start_bp, b.end_bp - b.start_bp)::double >= 0.5)"


def _matched(spark, sf_dir):
    return I.matched(V.ours(spark, sf_dir).select("chrom", "start_bp", "end_bp"), V.theirs(spark, sf_dir), ["chrom"], 0.5)


@query(f"WITH {V.SEGMENTS}, {_MATCHED} SELECT * FROM matched")
def matched_segments(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f"WITH {V.SEGMENTS}, {_MATCHED} SELECT round(corr(end_bp - start_bp, b_end - b_start), 6) AS length_correlation FROM matched")
def length_correlation(spark, sf_dir):
    return I.length_correlation(_matched(spark, sf_dir))


@query(f"WITH {V.SEGMENTS}, {_MATCHED}, d AS (SELECT unnest([abs(start_bp - b_start), abs(end_bp - b_end)]) AS d FROM matched) SELECT round(avg(d), 6) AS mean_bp, round(median(d), 6) AS median_bp, max(d) AS max_bp, round(avg(CASE WHEN d <= 100 THEN 1.0 ELSE 0.0 END), 6) AS frac_within FROM d")
def boundary_accuracy(spark, sf_dir):
    return I.boundary_accuracy(_matched(spark, sf_dir), 100)


def _called(name: str, merged: str) -> str:
    return f"{name} AS (SELECT {_K}, w FROM {merged}, unnest(range(start_bp // 400, (end_bp - 1) // 400 + 1)) t(w) GROUP BY {_K}, w HAVING sum(least(end_bp, (w + 1) * 400) - greatest(start_bp, w * 400)) > 200)"


@query(f"WITH {V.SEGMENTS}, {_merged('a', 'ours')}, {_merged('b', 'theirs')}, {_called('ca', 'a')}, {_called('cb', 'b')} SELECT {_K}, round((1000000 - count(*) FILTER (ca.w IS NULL OR cb.w IS NULL)) / 1000000::double, 6) AS concordance FROM ca FULL JOIN cb USING ({_K}, w) GROUP BY {_K}")
def window_concordance(spark, sf_dir):
    return I.window_concordance(V.ours(spark, sf_dir), V.theirs(spark, sf_dir), _KEYS, 400, 1_000_000)


PIECES = f"{V.GENETIC_MAP}, pieces AS (SELECT chrom, bp, cm, lead(bp) OVER m AS bp2, lead(cm) OVER m AS cm2, row_number() OVER m AS k, count(*) OVER (PARTITION BY chrom) AS n FROM gmap WINDOW m AS (PARTITION BY chrom ORDER BY bp))"
ON_PIECE = "p.bp2 IS NOT NULL AND ({0} >= p.bp OR p.k = 1) AND ({0} < p.bp2 OR p.k = p.n - 1)"
CM = "CASE WHEN {0} >= p.bp2 THEN p.cm2 + (p.cm2 - p.cm) / (p.bp2 - p.bp) * ({0} - p.bp2) ELSE p.cm + (p.cm2 - p.cm) / (p.bp2 - p.bp) * ({0} - p.bp) END"


@query(f"WITH {V.SEGMENTS}, {PIECES} SELECT seg.chrom, start_bp, count(*) AS n, round(max({CM.format('start_bp')}), 9) AS cm_at FROM seg JOIN pieces p ON p.chrom = seg.chrom AND {ON_PIECE.format('start_bp')} GROUP BY 1, 2")
def genmap_interp(spark, sf_dir):
    p = V.segments(spark, sf_dir).groupBy("chrom", F.col("start_bp").alias("pos")).agg(F.count(F.lit(1)).alias("times"))
    return G.interpolate(p, V.genetic_map(spark)).select("chrom", F.col("pos").alias("start_bp"), F.col("times").alias("n"), F.round("cm_at", 9).alias("cm_at"))


# Ordered analytics.


@query(f"WITH {V.TRACK} SELECT sample, state, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_windows, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM {_ISLAND} GROUP BY sample, run, state")
def state_runs(spark, sf_dir):
    return L.runs(V.track(spark, sf_dir), ["sample"], "pos", "state", "value").withColumn("mean_value", F.round("mean_value", 6))


_SIMRUN = "marked AS (SELECT *, CASE WHEN identity >= 0.999 THEN 1 ELSE 0 END AS state, row_number() OVER (PARTITION BY chrom, hap_a, hap_b ORDER BY start_bp) AS idx FROM sim), isl AS (SELECT *, sum(CASE WHEN state = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, hap_a, hap_b ORDER BY idx) AS run FROM marked), rle AS (SELECT chrom, hap_a, hap_b, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_windows, avg(identity) AS mean_posterior, min(identity) AS min_posterior, max(identity) AS max_posterior, sum(identity) AS lod_score FROM isl WHERE state = 1 GROUP BY chrom, hap_a, hap_b, run HAVING count(*) >= 2)"


def _rle(spark, sf_dir):
    from pyspark.sql import Window

    s = V.similarity(spark, sf_dir).withColumn("state", (F.col("identity") >= 0.999).cast("int"))
    s = s.withColumn("idx", F.row_number().over(Window.partitionBy(*_KEYS).orderBy("start_bp")))
    return L.shared_segments(s, _KEYS, "idx", "state", "identity", "identity", min_windows=2).withColumnRenamed("first_pos", "start_idx").withColumnRenamed("last_pos", "end_idx")


@query(f"WITH {V.SIM}, {_SIMRUN} SELECT chrom, hap_a, hap_b, start_idx, end_idx, n_windows, round(mean_posterior, 9) AS mean_identity, min_posterior AS min_identity FROM rle")
def rle_segments(spark, sf_dir):
    return _rle(spark, sf_dir).select(*_KEYS, "start_idx", "end_idx", "n_windows", F.round("mean_posterior", 9).alias("mean_identity"), F.col("min_posterior").alias("min_identity"))


@query(f"""WITH {V.SIM}, {_SIMRUN}, g AS (SELECT *, CASE WHEN start_idx - lag(end_idx) OVER (PARTITION BY {_K} ORDER BY start_idx) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM rle),
    h AS (SELECT *, sum(new) OVER (PARTITION BY {_K} ORDER BY start_idx) AS run2 FROM g)
    SELECT {_K}, min(start_idx) AS start_idx, max(end_idx) AS end_idx, round(sum(n_windows * mean_posterior) / sum(n_windows), 9) AS mean_posterior, min(min_posterior) AS min_posterior, max(max_posterior) AS max_posterior, round(sum(lod_score), 6) AS lod_score, max(end_idx) - min(start_idx) + 1 AS n_windows FROM h GROUP BY {_K}, run2""")
def merge_nearby(spark, sf_dir):
    return L.merge_nearby(_rle(spark, sf_dir), _KEYS, 2).withColumn("mean_posterior", F.round("mean_posterior", 9)).withColumn("lod_score", F.round("lod_score", 6))


_BIN = "bin AS (SELECT sample, pos, CASE WHEN value < 8 THEN 1 ELSE 0 END AS s, round(8 / (8 + value), 9) AS p FROM track)"


def _bin(spark, sf_dir):
    return V.track(spark, sf_dir).select("sample", "pos", (F.col("value") < 8).cast("int").alias("s"), F.round(8 / (8 + F.col("value")), 9).alias("p"))


@query(f"""WITH {V.TRACK}, {_BIN}, r AS (SELECT *, sum(new) OVER (PARTITION BY sample ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY sample ORDER BY pos) = s THEN 0 ELSE 1 END AS new FROM bin)),
    t AS (SELECT sample, run, s AS rs, count(*) AS n, avg(p) AS m, max(max(run)) OVER (PARTITION BY sample) AS last FROM r GROUP BY 1, 2, 3)
    SELECT r.sample, pos, s, CASE WHEN s = 0 AND n <= 2 AND m >= 0.3 AND run > 1 AND run < last THEN 1 ELSE s END AS bridged FROM r JOIN t USING (sample, run)""")
def bridge_gaps(spark, sf_dir):
    return L.bridge_gaps(_bin(spark, sf_dir), ["sample"], "pos", "s", "p", 2, 0.3).select("sample", "pos", "s", "bridged")


@query(f"""WITH {V.TRACK}, {_BIN}, h AS (SELECT *, CASE WHEN p >= 0.4 OR s = 1 THEN 1 ELSE 0 END AS h FROM bin),
    r AS (SELECT *, sum(new) OVER (PARTITION BY sample ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(h) OVER (PARTITION BY sample ORDER BY pos) = h THEN 0 ELSE 1 END AS new FROM h))
    SELECT sample, pos, CASE WHEN h = 1 AND max(s) OVER (PARTITION BY sample, run) = 1 THEN 1 ELSE 0 END AS extended FROM r""")
def extend_states(spark, sf_dir):
    return L.extend_states(_bin(spark, sf_dir), ["sample"], "pos", "s", "p", 0.4).select("sample", "pos", "extended")


@query(f"WITH {V.TRACK} SELECT sample, pos AS position, f AS from_state, state AS to_state FROM (SELECT *, lag(state) OVER (PARTITION BY sample ORDER BY pos) AS f FROM track) WHERE f <> state")
def switch_points(spark, sf_dir):
    return L.switch_points(V.track(spark, sf_dir), ["sample"], "pos", "state")


@query(_sim("SELECT chrom, hap_a, hap_b, start_bp, round(avg(identity) OVER (PARTITION BY chrom, hap_a, hap_b ORDER BY start_bp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS smoothed FROM sim"))
def emission_smooth(spark, sf_dir):
    return L.smoothed(V.similarity(spark, sf_dir), _KEYS, "start_bp", "identity", 2).select(*_KEYS, "start_bp", F.round("smoothed", 9).alias("smoothed"))


@query(f"WITH {V.TRACK}, {_BIN} SELECT sample, pos, round(sum(p * p) OVER w / sum(p) OVER w, 6) AS smoothed FROM bin WINDOW w AS (PARTITION BY sample ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def emission_smooth_weighted(spark, sf_dir):
    return L.smoothed_weighted(_bin(spark, sf_dir), ["sample"], "pos", "p", "p", 3).select("sample", "pos", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH {V.TRACK}, {_BIN}, l AS (SELECT *, pos::double AS c, lag(p) OVER (PARTITION BY sample ORDER BY pos) AS p0, lag(pos::double) OVER (PARTITION BY sample ORDER BY pos) AS c0 FROM bin)
    SELECT sample, pos AS position, round(c0 + (0.5 - p0) / (p - p0) * (c - c0), 3) AS crossing, p >= 0.5 AS rises FROM l WHERE (p0 < 0.5) <> (p < 0.5)""")
def boundary_crossings(spark, sf_dir):
    return L.crossings(_bin(spark, sf_dir).withColumn("c", F.col("pos").cast("double")), ["sample"], "pos", "p", "c", 0.5)


_SW = "(SELECT sample, pos FROM (SELECT *, lag(state) OVER (PARTITION BY sample ORDER BY pos) AS f FROM track) WHERE f <> state)"
_SW2 = "(SELECT sample, pos FROM (SELECT *, lag(s) OVER (PARTITION BY sample ORDER BY pos) AS f FROM bin) WHERE f <> s)"


@query(f"WITH {V.TRACK}, {_BIN}, t AS {_SW}, u AS {_SW2} SELECT sample, t.pos AS position, min(abs(t.pos - u.pos))::double AS distance, coalesce(min(abs(t.pos - u.pos)) <= 50, false) AS within FROM t LEFT JOIN u USING (sample) GROUP BY sample, t.pos")
def switch_accuracy(spark, sf_dir):
    truth = L.switch_points(V.track(spark, sf_dir), ["sample"], "pos", "state").select("sample", "position")
    called = L.switch_points(_bin(spark, sf_dir), ["sample"], "pos", "s").select("sample", "position")
    return L.nearest(truth, called, ["sample"], "position", 50)


# Identity classes.

_FOUR = ("S0#1", "S0#2", "S1#1", "S1#2")
_BITS = [(f"{a}", f"{b}", 1 << k) for k, (a, b) in enumerate((x, y) for i, x in enumerate(_FOUR) for y in _FOUR[i + 1 :])]
_MASK = "CASE " + " ".join(f"WHEN hap_a = '{min(a, b)}' AND hap_b = '{max(a, b)}' THEN {m}" for a, b, m in _BITS) + " END"


@query(f"""WITH {V.SIM}, same AS (SELECT * FROM sim WHERE identity >= 0.998), cls(mask, delta) AS (VALUES {", ".join(map(str, identity9.class_table()))}),
    loci AS (SELECT chrom, start_bp, end_bp, bit_or({_MASK}) AS mask FROM same WHERE {_MASK} IS NOT NULL GROUP BY 1, 2, 3),
    c AS (SELECT delta, count(*) AS n FROM loci JOIN cls USING (mask) GROUP BY 1),
    w AS (SELECT greatest(0, (max(end_bp) - min(start_bp) + 1) // 10000 - (SELECT count(*) FROM loci)) AS n FROM same),
    t AS (SELECT delta, sum(n)::bigint AS n FROM (SELECT * FROM c UNION ALL SELECT 9, n FROM w) GROUP BY 1 HAVING sum(n) > 0)
    SELECT delta, n, round(n / (SELECT sum(n) FROM t), 6) AS proportion FROM t""")
def identity_deltas(spark, sf_dir):
    return identity9.identity_classes(V.similarity(spark, sf_dir).filter("identity >= 0.998"), _FOUR)


# Painting.

_NAMES = list(V.POPULATIONS)
_PIVOT = f"{_QR}, agg AS (SELECT sample, chrom, start_bp, end_bp, {', '.join(f'''coalesce(max(identity) FILTER (population = '{p}'), 0) AS s{k}''' for k, p in enumerate(_NAMES))} FROM qr GROUP BY 1, 2, 3, 4)"
_TOP = "greatest(s0, s1, s2)"
_SUM = "(" + " + ".join(f"CASE WHEN s{k} > 0 THEN exp((s{k} - {_TOP}) / 0.01) ELSE 0 END" for k in range(3)) + ")"


def _emitted(spark, sf_dir):
    return E.pivot(paint_pivot(spark, sf_dir), _NAMES).withColumn("e", E.log_softmax(F.col("sims"), 0.01))


@query(_PIVOT + " SELECT sample, chrom, start_bp, end_bp, " + ", ".join(f"CASE WHEN s{k} > 0 THEN round((s{k} - {_TOP}) / 0.01 - ln({_SUM}), 6) END AS e{k}" for k in range(3)) + " FROM agg")
def paint_emissions(spark, sf_dir):
    e = _emitted(spark, sf_dir)
    return e.select("sample", "chrom", "start_bp", "end_bp", *[F.when(F.col("sims")[k] > 0, F.round(F.col("e")[k], 6)).alias(f"e{k}") for k in range(3)])


@query(_PIVOT + " SELECT sample, start_bp, chrom, CASE WHEN s2 >= s0 AND s2 >= s1 THEN 2 WHEN s1 >= s0 THEN 1 ELSE 0 END AS best FROM agg")
def paint_argmax(spark, sf_dir):
    return _emitted(spark, sf_dir).select("sample", "start_bp", "chrom", E.argmax(F.col("sims")).alias("best"))


@query(_PIVOT + f", t AS (SELECT *, {_TOP} AS top, (CASE WHEN s0 = {_TOP} AND s0 > 0 THEN 1 ELSE 0 END + CASE WHEN s1 = {_TOP} AND s1 > 0 THEN 1 ELSE 0 END + CASE WHEN s2 = {_TOP} AND s2 > 0 THEN 1 ELSE 0 END) AS ties FROM agg) SELECT sample, chrom, start_bp, " + ", ".join(f"round(ln((sum(CASE WHEN s{k} = top AND s{k} > 0 THEN 1.0::double / ties ELSE 0 END) OVER w + 0.5) / (count(*) OVER w + 1)), 6) AS c{k}" for k in range(3)) + " FROM t WINDOW w AS (PARTITION BY sample, chrom ORDER BY start_bp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def paint_consistency(spark, sf_dir):
    c = E.consistency(_emitted(spark, sf_dir), ["sample", "chrom"], "start_bp", "sims", 3, 2)
    return c.select("sample", "chrom", "start_bp", *[F.round(F.col("consistency")[k], 6).alias(f"c{k}") for k in range(3)])


@query(_PIVOT + f", f AS (SELECT *, (CASE WHEN s0 > 0 THEN (s0 - {_TOP}) / 0.01 ELSE 0 END + CASE WHEN s1 > 0 THEN (s1 - {_TOP}) / 0.01 ELSE 0 END + CASE WHEN s2 > 0 THEN (s2 - {_TOP}) / 0.01 ELSE 0 END) / ((s0 > 0)::int + (s1 > 0)::int + (s2 > 0)::int) AS m FROM agg) SELECT sample, chrom, start_bp, " + ", ".join(f"CASE WHEN s{k} > 0 THEN round((s{k} - {_TOP}) / 0.01 - m, 6) + 0.0 END AS e{k}" for k in range(3)) + " FROM f")
def paint_contrast(spark, sf_dir):
    e = _emitted(spark, sf_dir).withColumn("x", E.contrast(F.col("e")))
    return e.select("sample", "chrom", "start_bp", *[F.when(F.col("sims")[k] > 0, F.round(F.col("x")[k], 6) + F.lit(0.0)).alias(f"e{k}") for k in range(3)])


_COMB = _PIVOT + f""", em AS (SELECT *, {_TOP} AS top, {", ".join(f"CASE WHEN s{k} > 0 THEN (s{k} - {_TOP}) / 0.01 - ln({_SUM}) END AS e{k}" for k in range(3))} FROM agg),
    ti AS (SELECT *, (CASE WHEN s0 = top AND s0 > 0 THEN 1 ELSE 0 END + CASE WHEN s1 = top AND s1 > 0 THEN 1 ELSE 0 END + CASE WHEN s2 = top AND s2 > 0 THEN 1 ELSE 0 END) AS ties FROM em),
    co AS (SELECT *, {", ".join(f"ln((sum(CASE WHEN s{k} = top AND s{k} > 0 THEN 1.0::double / ties ELSE 0 END) OVER w + 0.5) / (count(*) OVER w + 1)) AS c{k}" for k in range(3))} FROM ti WINDOW w AS (PARTITION BY sample, chrom ORDER BY start_bp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query(_COMB + " SELECT sample, chrom, start_bp, " + ", ".join(f"round(CASE WHEN e{k} IS NULL THEN c{k} ELSE 0.7 * e{k} + 0.3 * c{k} END, 5) AS b{k}" for k in range(3)) + " FROM co")
def paint_blend(spark, sf_dir):
    c = E.consistency(_emitted(spark, sf_dir), ["sample", "chrom"], "start_bp", "sims", 3, 2).withColumn("b", E.blend(F.col("e"), F.col("consistency"), 0.3))
    return c.select("sample", "chrom", "start_bp", *[F.round(F.col("b")[k], 5).alias(f"b{k}") for k in range(3)])


_BEST = lambda p: f"CASE WHEN coalesce({p}2, -1e9) >= coalesce({p}0, -1e9) AND coalesce({p}2, -1e9) >= coalesce({p}1, -1e9) THEN 2 WHEN coalesce({p}1, -1e9) >= coalesce({p}0, -1e9) THEN 1 ELSE 0 END"


@query(_COMB + f", ag AS (SELECT *, least(0.95, 0.3 * CASE WHEN {_BEST('e')} = {_BEST('c')} THEN 1.5 ELSE 0.2 END) AS w FROM co) SELECT sample, chrom, start_bp, " + ", ".join(f"round(CASE WHEN e{k} IS NULL THEN c{k} ELSE (1 - w) * e{k} + w * c{k} END, 4) AS b{k}" for k in range(3)) + " FROM ag")
def paint_agreement(spark, sf_dir):
    c = E.consistency(_emitted(spark, sf_dir), ["sample", "chrom"], "start_bp", "sims", 3, 2).withColumn("b", E.blend_agreement(F.col("e"), F.col("consistency"), 0.3))
    return c.select("sample", "chrom", "start_bp", *[F.round(F.col("b")[k], 4).alias(f"b{k}") for k in range(3)])


# Hidden Markov models.

_FP = {"enter": 1e-3, "leave": 0.02, "start": 1e-3}
_LN = lambda p: f"ln({p!r}::double)"
_DENS = lambda m, s: f"(-0.5 * ((identity - {m!r}) / {s!r}::double) * ((identity - {m!r}) / {s!r}::double) - {math.log(s) + 0.5 * math.log(2 * math.pi)!r})"
_ADD = lambda a, b: f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


@query(f"""WITH RECURSIVE {V.SIM}, ob AS (SELECT chrom, hap_a, hap_b, row_number() OVER (PARTITION BY chrom, hap_a, hap_b ORDER BY start_bp) AS t, {_DENS(0.9985, 0.001)} AS e0, {_DENS(0.9997, 0.0005)} AS e1 FROM sim),
    fw AS (SELECT chrom, hap_a, hap_b, t, {_LN(1 - _FP['start'])} + e0 AS a0, {_LN(_FP['start'])} + e1 AS a1 FROM ob WHERE t = 1
        UNION ALL SELECT o.chrom, o.hap_a, o.hap_b, o.t, {_ADD(f"a0 + {_LN(1 - _FP['enter'])}", f"a1 + {_LN(_FP['leave'])}")} + e0, {_ADD(f"a0 + {_LN(_FP['enter'])}", f"a1 + {_LN(1 - _FP['leave'])}")} + e1
        FROM fw JOIN ob o ON o.chrom = fw.chrom AND o.hap_a = fw.hap_a AND o.hap_b = fw.hap_b AND o.t = fw.t + 1)
    SELECT chrom, hap_a, hap_b, max(t) AS n_windows, round(max_by({_ADD('a0', 'a1')}, t), 4) AS log_likelihood FROM fw GROUP BY 1, 2, 3""")
def ibd_forward(spark, sf_dir):
    from pairloom.functions.folds import log_likelihood

    s = V.similarity(spark, sf_dir)
    out = log_likelihood(s, _KEYS, "start_bp", C.gaussian_log_pdf("identity", 0.9985, 0.001), C.gaussian_log_pdf("identity", 0.9997, 0.0005), **_FP)
    return out.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query()
def ibd_posteriors(spark, sf_dir):
    """Decoded windows with trained parameters; not for SQL (Baum-Welch)."""
    from pairloom.plans.pairs import PairOptions, decode_windows

    return decode_windows(V.similarity(spark, sf_dir), PairOptions())


@query()
def ibd_segments(spark, sf_dir):
    from pairloom.plans.pairs import PairOptions, detect_shared

    return detect_shared(V.similarity(spark, sf_dir), PairOptions(min_len_bp=50_000, min_lod=1.0))


@query()
def paint_segments(spark, sf_dir):
    from pairloom.plans.painting import PaintOptions, paint

    return paint(V.similarity(spark, sf_dir), V.populations(spark), list(V.QUERIES), PaintOptions(estimate=True))


@query()
def tract_timing(spark, sf_dir):
    from pairloom.kernels.timing import TimingOptions
    from pairloom.plans.painting import timing

    tracts = L.runs(V.track(spark, sf_dir), ["sample"], "pos", "state")
    return timing(tracts.select("sample", F.concat(F.lit("P"), F.col("state").cast("string")).alias("ancestry"), F.lit(0).alias("start_bp"), (F.col("last_pos") - F.col("first_pos") + 1).alias("end_bp")), TimingOptions(least_bp=0.5))


# Scoring.


@query(f"WITH {V.SEGMENTS} SELECT chrom, hap_a, w AS window, max_by(l_returnflag, {{'s': start_bp, 'l': l_returnflag}}) AS l_returnflag FROM seg, unnest(range(start_bp // 2000, (greatest(start_bp, end_bp - 1)) // 2000 + 1)) t(w) GROUP BY 1, 2, 3")
def painted_windows(spark, sf_dir):
    from pairloom.operators.score import painted_windows as painted

    return painted(V.segments(spark, sf_dir), ["chrom", "hap_a"], "l_returnflag", 2000)


_HK = "chrom, s1, h1, s2, h2"
_HAPS = f"""{V.SEGMENTS}, hs AS (SELECT *, CASE WHEN hap_a <= hap_b THEN hap_a ELSE hap_b END AS x, CASE WHEN hap_a <= hap_b THEN hap_b ELSE hap_a END AS y FROM seg),
    hk AS (SELECT chrom, start_bp, end_bp, l_returnflag, split_part(x, '#', 1) AS hap_a, concat(split_part(x, '#', 2), '|', split_part(y, '#', 1), '|', split_part(y, '#', 2)) AS hap_b FROM hs),
    ho AS (SELECT * FROM hk WHERE l_returnflag <> 'N'), ht AS (SELECT * FROM hk WHERE l_returnflag = 'N'), {_merged('a', 'ho')}, {_merged('b', 'ht')},
    la AS (SELECT {_K}, sum(end_bp - start_bp)::bigint AS a_bp FROM a GROUP BY ALL), lb AS (SELECT {_K}, sum(end_bp - start_bp)::bigint AS b_bp FROM b GROUP BY ALL),
    lab AS (SELECT {_K}, sum(least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp))::bigint AS ab_bp FROM a JOIN b USING ({_K}) WHERE a.start_bp < b.end_bp AND b.start_bp < a.end_bp GROUP BY ALL),
    j AS (SELECT {_K}, coalesce(a_bp, 0) AS a_bp, coalesce(b_bp, 0) AS b_bp, coalesce(ab_bp, 0) AS ab_bp FROM la FULL JOIN lb USING ({_K}) LEFT JOIN lab USING ({_K}))"""


@query(f"WITH {_HAPS} SELECT chrom, hap_a AS sample1, split_part(hap_b, '|', 1)::int AS hap1, split_part(hap_b, '|', 2) AS sample2, split_part(hap_b, '|', 3)::int AS hap2, a_bp, b_bp, ab_bp, round(CASE WHEN a_bp + b_bp - ab_bp > 0 THEN ab_bp / (a_bp + b_bp - ab_bp)::double ELSE 0 END, 6) AS jaccard, round(CASE WHEN a_bp > 0 THEN ab_bp / a_bp::double ELSE 0 END, 6) AS precision, round(CASE WHEN b_bp > 0 THEN ab_bp / b_bp::double ELSE 0 END, 6) AS recall FROM j")
def haplotype_concordance(spark, sf_dir):
    from pairloom.operators.score import by_haplotype

    gold = V.theirs(spark, sf_dir).select("chrom", "start_bp", "end_bp", C.sample_of("hap_a").alias("sample1"), C.haplotype_index("hap_a").alias("hap1"), C.sample_of("hap_b").alias("sample2"), C.haplotype_index("hap_b").alias("hap2"))
    return by_haplotype(V.ours(spark, sf_dir), gold)


from pairloom import model_queries  # noqa: E402, F401  registers its queries beside these
