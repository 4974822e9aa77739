"""Queries of the panel, map and run operators, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom import queries as Q
from pairloom import views as V
from pairloom.operators import emissions as E
from pairloom.operators import genmap as G
from pairloom.operators import intervals as I
from pairloom.operators import islands as L
from pairloom.operators import panel as P
from pairloom.operators import report
from pairloom.operators import rows as R
from pairloom.operators import tracks as T
from pairloom.registry import query

KEYS, K = ["chrom", "hap_a", "hap_b"], "chrom, hap_a, hap_b"
SEQ, S = ["sample", "chrom"], "sample, chrom"
NAMES = list(V.POPULATIONS)
QR, PIVOT, COMB = Q._QR, Q._PIVOT, Q._COMB
each = lambda text: ", ".join(text.format(k=k) for k in range(len(NAMES)))
cells = lambda c, name, digits: [F.round(F.col(c)[k], digits).alias(f"{name}{k}") for k in range(len(NAMES))]


# Runs.

_GRID, _GAP, _LEAST = 400, 2, 0.9995
_CONT = f"st.s IS NOT NULL AND o.idx - st.last - 1 <= {_GAP} - st.gaps"
_GOOD = f"o.identity >= {_LEAST}"


@query(f"""WITH RECURSIVE {V.SIM}, ob AS (SELECT {K}, (start_bp - 1) // 10000 AS idx, start_bp, end_bp, identity, row_number() OVER (PARTITION BY {K} ORDER BY start_bp) AS t, count(*) OVER (PARTITION BY {K}) AS rows FROM sim),
    st AS (SELECT {K}, t, rows, CASE WHEN identity >= {_LEAST} THEN idx END AS s, CASE WHEN identity >= {_LEAST} THEN start_bp END AS sb, idx AS last, end_bp AS le, 0::bigint AS gaps, 1::bigint AS n, identity AS total, identity AS low,
            NULL::bigint AS cs, NULL::bigint AS cb, NULL::bigint AS ce, NULL::bigint AS cl, NULL::bigint AS cn, NULL::double AS ct, NULL::double AS cm FROM ob WHERE t = 1
        UNION ALL SELECT o.chrom, o.hap_a, o.hap_b, o.t, o.rows, CASE WHEN {_GOOD} THEN CASE WHEN {_CONT} THEN st.s ELSE o.idx END END, CASE WHEN {_GOOD} THEN CASE WHEN {_CONT} THEN st.sb ELSE o.start_bp END END, o.idx, o.end_bp,
            CASE WHEN {_CONT} THEN st.gaps + o.idx - st.last - 1 ELSE 0 END, CASE WHEN {_CONT} THEN st.n + 1 ELSE 1 END, CASE WHEN {_CONT} THEN st.total + o.identity ELSE o.identity END, CASE WHEN {_CONT} THEN least(st.low, o.identity) ELSE o.identity END,
            CASE WHEN NOT ({_CONT} AND {_GOOD}) THEN st.s END, st.sb, st.last + least(o.idx - st.last - 1, {_GAP} - st.gaps), st.le + 10000 * least(o.idx - st.last - 1, {_GAP} - st.gaps), st.n, st.total, st.low
        FROM st JOIN ob o ON o.chrom = st.chrom AND o.hap_a = st.hap_a AND o.hap_b = st.hap_b AND o.t = st.t + 1),
    done AS (SELECT {K}, cs, cb, ce, cl, cn, ct, cm FROM st WHERE cs IS NOT NULL
        UNION ALL SELECT {K}, s, sb, last + least({_GAP} - gaps, {_GRID} - 1 - last), le + 10000 * least({_GAP} - gaps, {_GRID} - 1 - last), n, total, low FROM st WHERE t = rows AND s IS NOT NULL)
    SELECT {K}, cs AS start_idx, cb AS start_bp, ce AS end_idx, cl AS end_bp, cn AS n_called, ce - cs + 1 AS n_windows, round(ct / cn, 9) AS mean_identity, cm AS min_identity, round(cn / (ce - cs + 1)::double, 9) AS fraction_called FROM done WHERE ce - cs + 1 >= 2 AND cl - cb + 1 >= 5000""")
def tolerant_runs(spark, sf_dir):
    s = V.similarity(spark, sf_dir).withColumn("idx", F.floor((F.col("start_bp") - 1) / 10_000))
    found = T.tolerant_runs(s, KEYS, _GRID, 10_000, _LEAST, _GAP, 2, 5000)
    return found.select(*KEYS, "start_idx", "start_bp", "end_idx", "end_bp", "n_called", "n_windows", F.round("mean_identity", 9).alias("mean_identity"), "min_identity", F.round(T.fraction_called(), 9).alias("fraction_called"))


_PIECES_SQL = f"pc AS (SELECT chrom, hap_a, start_bp, end_bp, start_bp // 400 AS start_idx, end_bp // 400 AS end_idx, (end_bp // 400 - start_bp // 400) // 2 + 1 AS n_called, 0.99 * ((end_bp // 400 - start_bp // 400) // 2 + 1) AS identity_sum, lod AS min_identity FROM seg)"


@query(f"""WITH {V.SEGMENTS}, {_PIECES_SQL}, r AS (SELECT *, max(end_idx) OVER (PARTITION BY chrom, hap_a ORDER BY start_bp, end_bp, start_idx, end_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY chrom, hap_a ORDER BY start_bp, end_bp, start_idx, end_idx) AS o FROM pc),
    f AS (SELECT *, CASE WHEN reach IS NULL OR start_idx > reach THEN 1 ELSE 0 END AS new, CASE WHEN reach IS NULL OR start_idx > reach THEN 1.0 ELSE greatest(end_idx - reach, 0) / (end_idx - start_idx + 1)::double END AS fresh FROM r),
    g AS (SELECT *, sum(new) OVER (PARTITION BY chrom, hap_a ORDER BY o) AS island FROM f)
    SELECT chrom, hap_a, min(start_idx) AS start_idx, max(end_idx) AS end_idx, min(start_bp) AS start_bp, max(end_bp) AS end_bp, max(end_idx) - min(start_idx) + 1 AS n_windows, sum(floor(n_called * fresh + 0.5)::bigint)::bigint AS n_called, round(sum(identity_sum * fresh), 6) AS identity_sum, min(min_identity) AS min_identity FROM g GROUP BY chrom, hap_a, island""")
def merge_overlapping(spark, sf_dir):
    s = V.segments(spark, sf_dir).selectExpr("chrom", "hap_a", "start_bp", "end_bp", "start_bp div 400 as start_idx", "end_bp div 400 as end_idx", "lod as min_identity")
    s = s.selectExpr("*", "(end_idx - start_idx) div 2 + 1 as n_called").selectExpr("*", "0.99D * n_called as identity_sum")
    return T.merge_overlapping(s, ["chrom", "hap_a"]).select("chrom", "hap_a", "start_idx", "end_idx", "start_bp", "end_bp", "n_windows", "n_called", F.round("identity_sum", 6).alias("identity_sum"), "min_identity")


@query(f"WITH {V.TRACK}, {Q._BIN} SELECT sample, s, round(coalesce(stddev_samp(p), 0), 6) AS posterior_std FROM bin GROUP BY 1, 2")
def posterior_std(spark, sf_dir):
    return T.posterior_std(Q._bin(spark, sf_dir), ["sample", "s"], "p").withColumn("posterior_std", F.round("posterior_std", 6))


@query(f"WITH {V.TRACK} SELECT sample, count(*) FILTER (state <> CASE WHEN value < 8 THEN 0 ELSE 1 END) AS changed FROM track GROUP BY 1")
def smoothing_changes(spark, sf_dir):
    t = V.track(spark, sf_dir).withColumn("after", F.when(F.col("value") < 8, 0).otherwise(1))
    return L.smoothing_changes(t, ["sample"], "state", "after")


_CROSS = f"{V.TRACK}, {Q._BIN}, l AS (SELECT *, lag(p) OVER (PARTITION BY sample ORDER BY pos) AS p0, lag(pos) OVER (PARTITION BY sample ORDER BY pos) AS c0 FROM bin), x AS (SELECT sample, pos, c0, round(c0 + (0.5 - p0) / (p - p0) * (pos - c0), 3) AS crossing, p >= 0.5 AS rises FROM l WHERE (p0 < 0.5) <> (p < 0.5))"
_HIGH = "(SELECT sample, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT *, sum(CASE WHEN s = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY pos) AS run FROM bin) WHERE s = 1 GROUP BY sample, run)"


@query(f"WITH {_CROSS}, h AS {_HIGH} SELECT h.sample, first_pos, last_pos, coalesce(a.crossing, first_pos::double) AS start_bp, coalesce(b.crossing, last_pos::double) AS end_bp FROM h LEFT JOIN x a ON a.sample = h.sample AND a.pos = first_pos AND a.rises LEFT JOIN x b ON b.sample = h.sample AND b.c0 = last_pos AND NOT b.rises")
def refined_boundaries(spark, sf_dir):
    rows = Q._bin(spark, sf_dir).withColumn("c", F.col("pos").cast("double"))
    runs = L.runs(rows, ["sample"], "pos", "s").filter("s = 1").select("sample", "first_pos", "last_pos", F.col("first_pos").alias("start_bp"), F.col("last_pos").alias("end_bp"))
    return L.refined_boundaries(runs, rows, ["sample"], "pos", "p", "c").select("sample", "first_pos", "last_pos", "start_bp", "end_bp")


_RUNS_OF = "(SELECT sample, {c} AS label, min(pos) AS start_bp, max(pos) + 1 AS end_bp FROM (SELECT *, sum(new) OVER (PARTITION BY sample ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag({c}) OVER (PARTITION BY sample ORDER BY pos) = {c} THEN 0 ELSE 1 END AS new FROM {t})) GROUP BY sample, run, {c})"


@query(f"""WITH {V.TRACK}, tr2 AS (SELECT *, CASE WHEN value < 7 THEN 0 WHEN value < 15 THEN 1 ELSE 2 END AS called FROM track), a AS {_RUNS_OF.format(c='called', t='tr2')}, b AS {_RUNS_OF.format(c='state', t='tr2')},
    la AS (SELECT sample, label, sum(end_bp - start_bp)::bigint AS a_bp FROM a GROUP BY 1, 2), lb AS (SELECT sample, label, sum(end_bp - start_bp)::bigint AS b_bp FROM b GROUP BY 1, 2),
    ab AS (SELECT sample, label, sum(least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp))::bigint AS ab_bp FROM a JOIN b USING (sample, label) WHERE a.start_bp < b.end_bp AND b.start_bp < a.end_bp GROUP BY 1, 2),
    j AS (SELECT sample, label, coalesce(a_bp, 0) AS a_bp, coalesce(b_bp, 0) AS b_bp, coalesce(ab_bp, 0) AS ab_bp FROM la FULL JOIN lb USING (sample, label) LEFT JOIN ab USING (sample, label))
    SELECT sample, label, a_bp, b_bp, ab_bp, round(CASE WHEN a_bp + b_bp - ab_bp > 0 THEN ab_bp / (a_bp + b_bp - ab_bp)::double ELSE 0 END, 6) AS jaccard, round(CASE WHEN a_bp > 0 THEN ab_bp / a_bp::double ELSE 0 END, 6) AS precision, round(CASE WHEN b_bp > 0 THEN ab_bp / b_bp::double ELSE 0 END, 6) AS recall FROM j""")
def population_agreement(spark, sf_dir):
    """Jaccard, precision and recall of segments by population."""
    t = V.track(spark, sf_dir).withColumn("called", F.expr("case when value < 7 then 0 when value < 15 then 1 else 2 end"))
    of = lambda c: L.runs(t, ["sample"], "pos", c).select("sample", F.col(c).alias("label"), F.col("first_pos").alias("start_bp"), (F.col("last_pos") + 1).alias("end_bp"))
    return I.agreement(of("called"), of("state"), ["sample", "label"])


@query(f"""WITH {V.TRACK}, c AS (SELECT *, CASE WHEN value < 7 THEN 0 WHEN value < 15 THEN 1 ELSE 2 END AS called FROM track), l AS (SELECT *, lag(state) OVER w AS s0, lag(called) OVER w AS c0 FROM c WINDOW w AS (PARTITION BY sample ORDER BY pos))
    SELECT sample, count(*) AS n_windows, round(avg(CASE WHEN state = called THEN 1.0 ELSE 0.0 END), 6) AS concordance, count(*) FILTER (s0 <> state) AS n_true_switches, count(*) FILTER (c0 <> called) AS n_predicted_switches FROM l GROUP BY 1""")
def concordance_report(spark, sf_dir):
    """What SQL can say of the report; the greedy matching has its own tests."""
    t = V.track(spark, sf_dir).withColumn("called", F.expr("case when value < 7 then 0 when value < 15 then 1 else 2 end"))
    found = report.concordance(t, ["sample"], "pos", "called", "state", 50)
    return found.select("sample", "n_windows", F.round("concordance", 6).alias("concordance"), "n_true_switches", "n_predicted_switches")


@query(f"WITH {V.SEGMENTS} SELECT chrom, hap_a, w AS start_bp FROM (SELECT chrom, hap_a, min(start_bp) AS lo, max(end_bp) AS hi FROM seg GROUP BY 1, 2), unnest(range(lo, hi, 100000)) t(w)")
def grid_starts(spark, sf_dir):
    return report.grid_starts(V.segments(spark, sf_dir), ["chrom", "hap_a"], 100_000)


# Gold segments.

_GOLD = "gold AS (SELECT chrom, split_part(hap_a, '#', 1) AS sample1, split_part(hap_b, '#', 1) AS sample2, start_bp, end_bp, lod FROM seg)"


def _gold(spark, sf_dir):
    from pairloom.functions.columns import sample_of

    return V.segments(spark, sf_dir).select("chrom", sample_of("hap_a").alias("sample1"), sample_of("hap_b").alias("sample2"), "start_bp", "end_bp", "lod")


@query(f"WITH {V.SEGMENTS}, {_GOLD} SELECT DISTINCT least(sample1, sample2) AS sample1, greatest(sample1, sample2) AS sample2 FROM gold")
def gold_pairs(spark, sf_dir):
    return P.unique_pairs(_gold(spark, sf_dir))


@query(f"WITH {V.SEGMENTS}, {_GOLD} SELECT * FROM gold WHERE chrom = 'chr2' AND lod >= 3 AND (sample1 = 'S1' AND sample2 = 'S3' OR sample1 = 'S3' AND sample2 = 'S1')")
def gold_segments(spark, sf_dir):
    return P.segments_in(_gold(spark, sf_dir), pair=("S1", "S3"), chrom="chr2", min_lod=3.0)


# Genetic map.

_AT = f"""{Q.PIECES}, w AS (SELECT {K}, start_bp, end_bp, (start_bp + end_bp) // 2 AS mid FROM sim),
    pts AS (SELECT DISTINCT chrom, mid AS x FROM w UNION SELECT DISTINCT chrom, mid + 10000 FROM w), cms AS (SELECT pts.chrom, x, max({Q.CM.format('x')}) AS cm FROM pts JOIN pieces p ON p.chrom = pts.chrom AND {Q.ON_PIECE.format('x')} GROUP BY 1, 2),
    placed AS (SELECT w.*, a.cm, b.cm AS cm_next FROM w JOIN cms a ON a.chrom = w.chrom AND a.x = mid JOIN cms b ON b.chrom = w.chrom AND b.x = mid + 10000),
    d AS (SELECT *, mid - lag(mid) OVER o AS step_bp, abs(cm - lag(cm) OVER o) AS step_cm, lag(cm) OVER o AS from_cm, lag(cm_next) OVER o AS from_cm_next FROM placed WINDOW o AS (PARTITION BY {K} ORDER BY start_bp, end_bp))"""


def _distances(spark, sf_dir):
    w = V.similarity(spark, sf_dir).select(*KEYS, "start_bp", "end_bp")
    return G.distances(w, V.genetic_map(spark), KEYS, 10_000)


@query(f"WITH {V.SIM}, {_AT} SELECT {K}, start_bp, step_bp, round(cm, 9) AS cm, round(step_cm, 9) AS step_cm FROM d")
def genmap_distance(spark, sf_dir):
    return _distances(spark, sf_dir).select(*KEYS, "start_bp", "step_bp", F.round("cm", 9).alias("cm"), F.round("step_cm", 9).alias("step_cm"))


@query(f"WITH {V.GENETIC_MAP} SELECT chrom, count(*) AS entries, min(bp) AS first_bp, max(bp) AS last_bp, round(arg_max(cm, bp) - arg_min(cm, bp), 6) AS length_cm, round((arg_max(cm, bp) - arg_min(cm, bp)) / (max(bp) - min(bp)) * 1000000, 6) AS cm_per_mb FROM gmap GROUP BY 1")
def genmap_summary(spark, sf_dir):
    s = G.summary(V.genetic_map(spark))
    return s.withColumn("length_cm", F.round("length_cm", 6)).withColumn("cm_per_mb", F.round("cm_per_mb", 6))


_HALDANE = "(0.5 * (1 - exp(-({0}) / 50.0)))"


@query(f"WITH {V.SIM}, {_AT} SELECT {K}, start_bp, round(least(0.5, greatest(1e-6, CASE WHEN step_bp > 0 THEN 0.01 * {_HALDANE.format('step_cm')} / {_HALDANE.format('step_bp / 1e6')} ELSE 0.01 END)), 8) AS switch FROM d WHERE step_bp IS NOT NULL")
def modulated_switch(spark, sf_dir):
    return _distances(spark, sf_dir).filter("step_bp is not null").select(*KEYS, "start_bp", F.round(G.modulated_switch(0.01), 8).alias("switch"))


_SCALE = "step_cm / CASE WHEN abs(from_cm_next - from_cm) > 0 THEN abs(from_cm_next - from_cm) ELSE 0.01 END"
_RATE = lambda p, x: f"CASE WHEN step_bp = 0 THEN {p} ELSE least(1 - 1e-10, greatest(1e-10, 1 - exp(ln(1 - {p}::double) * ({x})))) END"


@query(f"WITH {V.SIM}, {_AT} SELECT {K}, start_bp, round({_RATE(0.001, _SCALE)}, 8) AS enter, round({_RATE(0.02, f'({_SCALE}) * (1 + ' + _HALDANE.format('step_cm') + ')')}, 7) AS leave FROM d WHERE step_bp IS NOT NULL")
def map_transitions(spark, sf_dir):
    w = Window.partitionBy(*KEYS).orderBy("start_bp", "end_bp")
    d = _distances(spark, sf_dir).withColumn("from_cm", F.lag("cm").over(w)).withColumn("from_cm_next", F.lag("cm_next").over(w)).filter("step_bp is not null")
    enter, leave = G.map_rates(0.001, 0.02, 10_000)
    return d.select(*KEYS, "start_bp", F.round(enter, 8).alias("enter"), F.round(leave, 7).alias("leave"))


# The panel.


def _panel(spark, sf_dir):
    return R.query_reference(V.similarity(spark, sf_dir), list(V.QUERIES), V.populations(spark))


def _seen(spark, sf_dir):
    return E.pivot(_panel(spark, sf_dir), NAMES)


_IDX = f"{QR}, nr AS (SELECT *, dense_rank() OVER (PARTITION BY {S} ORDER BY start_bp, end_bp) AS idx FROM qr)"


@query(f"{_IDX} SELECT {S}, start_bp, end_bp, population, haplotype, round(avg(identity) OVER (PARTITION BY {S}, haplotype ORDER BY idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS identity FROM nr")
def panel_smoothed(spark, sf_dir):
    return P.smoothed(_panel(spark, sf_dir), 2).select(*P.WIN, "population", "haplotype", F.round("identity", 9).alias("identity"))


_BESTH = f"{QR}, bh AS (SELECT {S}, start_bp, end_bp, population, haplotype, row_number() OVER (PARTITION BY {S}, start_bp, end_bp ORDER BY identity DESC, haplotype) AS r FROM qr WHERE identity > 0), b1 AS (SELECT * FROM bh WHERE r = 1)"


@query(f"{_BESTH}, fr AS (SELECT *, list(haplotype) OVER (PARTITION BY {S} ORDER BY start_bp, end_bp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM b1), sh AS (SELECT *, CASE WHEN len(l) > 1 THEN (len(list_filter(l, lambda x: x = haplotype)) - 1) / (len(l) - 1)::double ELSE 0 END AS share FROM fr) SELECT {S}, start_bp, end_bp, " + ", ".join(f"CASE WHEN population = '{n}' THEN round(0.1 * 0.03 * share, 8) ELSE 0 END AS b{k}" for k, n in enumerate(NAMES)) + " FROM sh")
def panel_bonus(spark, sf_dir):
    return P.bonus(_panel(spark, sf_dir), NAMES, 3, 0.1, 0.03).select(*P.WIN, *cells("bonus", "b", 8))


@query(f"{QR}, rk AS (SELECT *, row_number() OVER (PARTITION BY {S}, start_bp, end_bp ORDER BY identity DESC, haplotype) AS r FROM qr), ct AS (SELECT {S}, start_bp, end_bp, " + ", ".join(f"count(*) FILTER (population = '{n}') + 0.5 AS n{k}" for k, n in enumerate(NAMES)) + f" FROM rk WHERE r <= 2 GROUP BY 1, 2, 3, 4) SELECT {S}, start_bp, end_bp, " + each("round(ln(n{k} / (n0 + n1 + n2)), 7) AS r{k}") + " FROM ct")
def panel_ranks(spark, sf_dir):
    return P.rank_shares(_panel(spark, sf_dir), NAMES, 2).select(*P.WIN, *cells("ranked", "r", 7))


_LONGS = "(SELECT unnest([0, 1, 2]) AS k, unnest([s0, s1, s2]) AS sim, * FROM agg)"
_NAMED = "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"


@query(f"{PIVOT} SELECT {_NAMED} AS population, round(coalesce(avg(sim) FILTER (sim > 0), 0), 9) AS mean, round(CASE WHEN count(*) FILTER (sim > 0) >= 2 THEN greatest(stddev_pop(sim) FILTER (sim > 0), 1e-6) ELSE 1e-6 END, 9) AS std FROM {_LONGS} GROUP BY 1")
def panel_normalization(spark, sf_dir):
    return P.normalization(_seen(spark, sf_dir), NAMES).select("population", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


_TOP3 = "greatest(s0, s1, s2)"


@query(f"{PIVOT}, x AS (SELECT k, sim, CASE WHEN s0 = {_TOP3} THEN 0 WHEN s1 = {_TOP3} THEN 1 ELSE 2 END AS top FROM {_LONGS} WHERE {_TOP3} > 0) SELECT round(avg(sim) FILTER (k = top), 9) AS same_mean, round(stddev_pop(sim) FILTER (k = top), 9) AS same_std, round(avg(sim) FILTER (k <> top), 9) AS other_mean, round(stddev_pop(sim) FILTER (k <> top), 9) AS other_std FROM x WHERE sim > 0")
def panel_same_other(spark, sf_dir):
    return P.same_and_other(_seen(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("same_mean", "same_std", "other_mean", "other_std")])


@query(f"{PIVOT}, m AS (SELECT k, {_NAMED} AS p, avg(sim) AS m, var_samp(sim) AS v FROM {_LONGS} GROUP BY 1, 2) SELECT a.p AS a, b.p AS b, round(least(100, abs(a.m - b.m) / sqrt((a.v + b.v) / 2)), 6) AS d, round(abs(a.m - b.m), 9) AS gap FROM m a JOIN m b ON a.k < b.k")
def panel_effect_sizes(spark, sf_dir):
    return P.effect_sizes(_seen(spark, sf_dir), NAMES).select("a", "b", F.round("d", 6).alias("d"), F.round("gap", 9).alias("gap"))


@query(f"{QR} SELECT {S}, start_bp, end_bp, " + ", ".join(f"round(coalesce(var_pop(identity) FILTER (population = '{n}'), 0), 12) AS v{k}" for k, n in enumerate(NAMES)) + " FROM qr GROUP BY 1, 2, 3, 4")
def panel_variance(spark, sf_dir):
    return P.window_variance(_panel(spark, sf_dir), NAMES).select(*P.WIN, *cells("variance", "v", 12))


@query(f"{QR}, rk AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY {S}, start_bp, end_bp, population) AS n FROM qr WHERE identity > 0 WINDOW w AS (PARTITION BY {S}, start_bp, end_bp, population ORDER BY identity DESC, haplotype)) SELECT {S}, start_bp, end_bp, " + ", ".join(f"coalesce(max(identity) FILTER (population = '{n}'), 0) AS s{k}" for k, n in enumerate(NAMES)) + " FROM rk WHERE r > 1 OR n = 1 GROUP BY 1, 2, 3, 4")
def panel_without_best(spark, sf_dir):
    return P.without_best(_panel(spark, sf_dir), NAMES).select(*P.WIN, *[F.col("sims_loo")[k].alias(f"s{k}") for k in range(3)])


@query(f"{QR}, rk AS (SELECT *, row_number() OVER w AS r, lead(population) OVER w AS nx FROM qr WHERE identity > 0 WINDOW w AS (PARTITION BY {S}, start_bp, end_bp ORDER BY identity DESC, haplotype)) SELECT haplotype, round((count(*) FILTER (nx = population) + 1) / (count(*) + 2)::double, 9) AS purity FROM rk WHERE r = 1 AND nx IS NOT NULL GROUP BY 1")
def panel_purity(spark, sf_dir):
    return P.purity(_panel(spark, sf_dir)).withColumn("purity", F.round("purity", 9))


# Emission models and blends.

_D = lambda i, j: f"CASE WHEN s{i} > 0 AND s{j} > 0 THEN s{i} - s{j} ELSE 0 END"
_SD = ", ".join(f"greatest(stddev_pop({_D(i, j)}) OVER q, 1e-6) AS t{i}{j}" for i in range(3) for j in range(i + 1, 3))
_ODDS = lambda i, j: f"(-ln(1 + exp(-(({_D(i, j)}) / t{min(i, j)}{max(i, j)}))))"
_PAIRWISE = f"{PIVOT}, sd AS (SELECT *, {_SD} FROM agg WINDOW q AS (PARTITION BY {S})), sc AS (SELECT *, " + ", ".join(f"({' + '.join(_ODDS(i, j) for j in range(3) if j != i)}) / 2 AS b{i}" for i in range(3)) + " FROM sd), pw AS (SELECT *, ln(exp(b0) + exp(b1) + exp(b2)) AS lz FROM sc)"


@query(f"{_PAIRWISE} SELECT {S}, start_bp, end_bp, " + each("CASE WHEN s{k} > 0 THEN round(b{k} - lz, 6) END AS p{k}") + " FROM pw")
def paint_pairwise(spark, sf_dir):
    rows = E.pairwise(_seen(spark, sf_dir), SEQ, "sims", 3)
    return rows.select(*P.WIN, *[F.when(F.col("sims")[k] > 0, F.round(F.col("pairwise")[k], 6)).alias(f"p{k}") for k in range(3)])


_M = "(greatest(c0, c1, c2) - (c0 + c1 + c2 - greatest(c0, c1, c2) - least(c0, c1, c2)))"
_MARGINS = f"{COMB}, mg AS (SELECT *, {_M} AS m FROM co), md AS (SELECT {S}, coalesce(list_sort(list(m) FILTER (m > 1e-12))[(count(*) FILTER (m > 1e-12)) // 2 + 1], 1) AS med FROM mg GROUP BY 1, 2)"


def _margins(spark, sf_dir):
    c = E.consistency(Q._emitted(spark, sf_dir), SEQ, "start_bp", "sims", 3, 2)
    m = E.margin(F.col("consistency"))
    return c.join(E.upper_median(c, SEQ, F.when(m > 1e-12, m)), SEQ, "left").withColumn("median_margin", F.coalesce("median_margin", F.lit(1.0)))


_MIX = each("round(CASE WHEN e{k} IS NULL THEN c{k} ELSE (1 - w) * e{k} + w * c{k} END, 4) AS b{k}")


@query(_MARGINS + f", ag AS (SELECT *, least(0.95, 0.3 * least(2.5, greatest(0.1, m / med))) AS w FROM mg JOIN md USING ({S})) SELECT {S}, start_bp, {_MIX} FROM ag")
def paint_adaptive(spark, sf_dir):
    rows = _margins(spark, sf_dir)
    return rows.withColumn("b", E.blend_adaptive(F.col("e"), F.col("consistency"), 0.3, F.col("median_margin"))).select("sample", "chrom", "start_bp", *cells("b", "b", 4))


_SAME = f"{Q._BEST('e')} = {Q._BEST('c')}"


@query(_MARGINS + f", ag AS (SELECT *, least(0.95, greatest(0, 0.3 * CASE WHEN {_SAME} THEN 1.5 * least(3, greatest(0.2, m / med)) ELSE 0.2 END)) AS w FROM mg JOIN md USING ({S})) SELECT {S}, start_bp, {_MIX} FROM ag")
def paint_hybrid(spark, sf_dir):
    rows = _margins(spark, sf_dir)
    return rows.withColumn("b", E.blend_hybrid(F.col("e"), F.col("consistency"), 0.3, F.col("median_margin"))).select("sample", "chrom", "start_bp", *cells("b", "b", 4))


_AGREE, _DIFFER = [1.5, 1.2, 0.9], [[0.2, 0.3, 0.1], [0.3, 0.2, 0.4], [0.1, 0.4, 0.2]]
_SCALED = f"CASE WHEN {_SAME} THEN [1.5, 1.2, 0.9][{Q._BEST('e')} + 1] ELSE [0.2, 0.3, 0.1, 0.3, 0.2, 0.4, 0.1, 0.4, 0.2][({Q._BEST('e')}) * 3 + ({Q._BEST('c')}) + 1] END"


@query(COMB + f", ag AS (SELECT *, least(0.95, greatest(0, 0.3 * {_SCALED})) AS w FROM co) SELECT {S}, start_bp, {_MIX} FROM ag")
def paint_population_blend(spark, sf_dir):
    c = E.consistency(Q._emitted(spark, sf_dir), SEQ, "start_bp", "sims", 3, 2)
    return c.withColumn("b", E.blend_looked_up(F.col("e"), F.col("consistency"), 0.3, _AGREE, _DIFFER)).select("sample", "chrom", "start_bp", *cells("b", "b", 4))


_EM = PIVOT + f", em AS (SELECT *, {', '.join(f'CASE WHEN s{k} > 0 THEN (s{k} - {_TOP3}) / 0.01 - ln({Q._SUM}) END AS e{k}' for k in range(3))} FROM agg)"


@query(_EM + f", mm AS (SELECT *, list_sort([e0, e1, e2], 'DESC', 'NULLS LAST') AS l FROM em), m2 AS (SELECT *, CASE WHEN l[2] IS NULL THEN 0 ELSE l[1] - l[2] END AS m FROM mm), f AS (SELECT *, CASE WHEN median(m) OVER (PARTITION BY {S}) * 1.5 > 0 THEN least(1, m / (median(m) OVER (PARTITION BY {S}) * 1.5)) ELSE 0 END AS f FROM m2) SELECT {S}, start_bp, " + each("round(f * e{k} + (1 - f) * ln(1 / 3.0::double), 5) AS e{k}") + " FROM f")
def paint_dampen(spark, sf_dir):
    rows = E.dampen(Q._emitted(spark, sf_dir), SEQ, "e", 1.5)
    return rows.select("sample", "chrom", "start_bp", *[F.when(F.col("sims")[k] > 0, F.round(F.col("dampened")[k], 5)).alias(f"e{k}") for k in range(3)])


_TEMPS = [0.01, 0.02, 0.015]


@query(PIVOT + f", sc AS (SELECT *, {', '.join(f'CASE WHEN s{k} > 0 THEN s{k} / {t} END AS x{k}' for k, t in enumerate(_TEMPS))} FROM agg), tp AS (SELECT *, greatest(coalesce(x0, -1e9), coalesce(x1, -1e9), coalesce(x2, -1e9)) AS top FROM sc) SELECT {S}, start_bp, " + each("round(x{k} - top - ln(coalesce(exp(x0 - top), 0) + coalesce(exp(x1 - top), 0) + coalesce(exp(x2 - top), 0)), 5) AS e{k}") + " FROM tp")
def paint_by_state(spark, sf_dir):
    rows = _seen(spark, sf_dir).withColumn("e", E.softmax_by_state(F.col("sims"), _TEMPS))
    return rows.select("sample", "chrom", "start_bp", *[F.when(F.col("sims")[k] > 0, F.round(F.col("e")[k], 5)).alias(f"e{k}") for k in range(3)])


@query(PIVOT + f""", g AS (SELECT *, greatest(s0, s1) AS g0, s2 AS g1 FROM agg),
    h AS (SELECT *, CASE WHEN g0 > 0 THEN (g0 - greatest(g0, g1)) / 0.01 - ln(CASE WHEN g0 > 0 THEN exp((g0 - greatest(g0, g1)) / 0.01) ELSE 0 END + CASE WHEN g1 > 0 THEN exp((g1 - greatest(g0, g1)) / 0.01) ELSE 0 END) END AS q0,
        CASE WHEN g1 > 0 THEN (g1 - greatest(g0, g1)) / 0.01 - ln(CASE WHEN g0 > 0 THEN exp((g0 - greatest(g0, g1)) / 0.01) ELSE 0 END + CASE WHEN g1 > 0 THEN exp((g1 - greatest(g0, g1)) / 0.01) ELSE 0 END) END AS q1,
        CASE WHEN g0 > 0 THEN ln(CASE WHEN s0 > 0 THEN exp((s0 - g0) / 0.01) ELSE 0 END + CASE WHEN s1 > 0 THEN exp((s1 - g0) / 0.01) ELSE 0 END) END AS z0 FROM g),
    i AS (SELECT *, CASE WHEN s0 > 0 THEN 0.5 * q0 + 0.5 * ((s0 - g0) / 0.01 - z0) END AS x0, CASE WHEN s1 > 0 THEN 0.5 * q0 + 0.5 * ((s1 - g0) / 0.01 - z0) END AS x1, CASE WHEN s2 > 0 THEN 0.5 * q1 END AS x2 FROM h)
    SELECT {S}, start_bp, """ + each("round(x{k} - ln(coalesce(exp(x0), 0) + coalesce(exp(x1), 0) + coalesce(exp(x2), 0)), 5) AS e{k}") + " FROM i")
def paint_hierarchical(spark, sf_dir):
    rows = _seen(spark, sf_dir).withColumn("e", E.hierarchical(F.col("sims"), [[0, 1], [2]], 0.01))
    return rows.select("sample", "chrom", "start_bp", *[F.when(F.col("sims")[k] > 0, F.round(F.col("e")[k], 5)).alias(f"e{k}") for k in range(3)])


_MEANS, _STDS = [0.998, 0.9985, 0.999], [0.001, 0.0012, 0.0008]


@query(PIVOT + f", z AS (SELECT *, {', '.join(f'CASE WHEN s{k} > 0 THEN (s{k} - {m}) / {d} END AS z{k}' for k, (m, d) in enumerate(zip(_MEANS, _STDS)))} FROM agg), t AS (SELECT *, greatest(coalesce(z0, -1e9), coalesce(z1, -1e9), coalesce(z2, -1e9)) AS top FROM z) SELECT {S}, start_bp, " + each("round((z{k} - top) / 1.5 - ln(coalesce(exp((z0 - top) / 1.5), 0) + coalesce(exp((z1 - top) / 1.5), 0) + coalesce(exp((z2 - top) / 1.5), 0)), 5) AS e{k}") + " FROM t")
def paint_standardised(spark, sf_dir):
    rows = _seen(spark, sf_dir).withColumn("e", E.softmax_of(E.z_scores(F.col("sims"), _MEANS, _STDS), 1.5))
    return rows.select("sample", "chrom", "start_bp", *[F.when(F.col("sims")[k] > 0, F.round(F.col("e")[k], 5)).alias(f"e{k}") for k in range(3)])


# Cross validation: each reference haplotype painted with the others.

_REFS = f"""WITH {V.SIM}, {V.POPULATIONS_SQL}, sides AS (SELECT *, hap_a AS sample, hap_b AS hap FROM sim UNION ALL SELECT *, hap_b, hap_a FROM sim),
    lv AS (SELECT sample, chrom, start_bp, end_bp, q.population AS truth, {", ".join(f"coalesce(max(identity) FILTER (p.population = '{n}'), 0) AS s{k}" for k, n in enumerate(NAMES))} FROM sides JOIN pops p ON hap = p.haplotype JOIN pops q ON sample = q.haplotype GROUP BY 1, 2, 3, 4, 5),
    cl AS (SELECT truth, CASE WHEN s2 >= s0 AND s2 >= s1 THEN '{NAMES[2]}' WHEN s1 >= s0 THEN '{NAMES[1]}' ELSE '{NAMES[0]}' END AS called FROM lv),
    pr AS (SELECT x AS population, count(*) FILTER (truth = x) AS windows, count(*) FILTER (called = x) AS called, count(*) FILTER (truth = x AND called = x) AS correct FROM cl, (SELECT DISTINCT truth AS x FROM cl) GROUP BY 1),
    al AS (SELECT * FROM pr UNION ALL SELECT 'overall', sum(windows), sum(called), sum(correct) FROM pr)"""


@query(f"{_REFS} SELECT population, windows::bigint AS windows, correct::bigint AS correct, round(correct / windows::double, 6) AS accuracy, round(CASE WHEN called > 0 THEN correct / called::double ELSE 0 END, 6) AS precision FROM al")
def cross_validation(spark, sf_dir):
    from pairloom.plans.painting import cross_validated

    pops = V.populations(spark)
    long = R.query_reference(V.similarity(spark, sf_dir), [h for hs in V.POPULATIONS.values() for h in hs], pops)
    best = E.pivot(long, NAMES).withColumn("state", E.argmax(F.col("sims")))
    found = cross_validated(best, pops, NAMES)
    return found.select("population", "windows", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision"))


@query()
def paint_with_map(spark, sf_dir):
    """Painting along the genetic map, with the pairwise model in a hybrid blend; not for SQL
    (forward-backward and Viterbi), see tests/test_painting_options.py."""
    from pairloom.plans.painting import PaintOptions, paint

    return paint(V.similarity(spark, sf_dir), V.populations(spark), list(V.QUERIES), PaintOptions(temperature=0.01, switch=0.01, pairwise_weight=0.3, blend="hybrid"), gmap=V.genetic_map(spark))


@query()
def ibd_with_map(spark, sf_dir):
    """Shared segments with transitions along the genetic map; not for SQL (Baum-Welch)."""
    from pairloom.plans.pairs import PairOptions, detect_shared

    return detect_shared(V.similarity(spark, sf_dir), PairOptions(min_len_bp=50_000, min_lod=1.0), gmap=V.genetic_map(spark))
