"""Painting: each query haplotype's windows with one of K populations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.kernels import chain, estimates, states, transforms
from pairloom.kernels import transitions as rules
from pairloom.kernels.paint_models import parse_groups
from pairloom.kernels.timing import TimingOptions, pulses
from pairloom.operators import emissions as E
from pairloom.operators import genmap as G
from pairloom.operators import panel as P
from pairloom.operators.islands import runs
from pairloom.operators.rows import mask_out, query_reference
from pairloom.shipping import ship

KEYS = ["sample", "chrom"]
BATCH_ROWS = 100_000
RULES = ("adaptive", "boundary_boost", "cooccurrence", "confusion", "momentum", "segment_length", "lookahead", "recency", "disagreement")


@dataclass(frozen=True)
class PaintOptions:
    """Options of the painting, with their defaults."""

    emission_model: str = "max"
    top: int = 2
    temperature: float | None = None
    switch: float = 0.001
    estimate: bool = False
    identity_floor: float = 0.0
    emission_context: int = 0
    contrast: bool = False
    consistency_weight: float = 0.0
    consistency_context: int = 5
    label_smooth: float = 0.0
    decoding: str = "viterbi"
    #: Second pass: each sample's own proportions and switch rates, and transforms by name.
    two_pass: bool = False
    transforms: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()
    #: A transition rule of the second pass by name, with its parameters.
    transition: tuple[str, tuple[tuple[str, float], ...]] | None = None
    #: Before the pivot: smoothing of each haplotype, and weights by the panel's purity.
    sims_context: int = 0
    purity_power: float = 0.0
    #: Emission models beside the softmax of similarities, and how the pairwise one is blended.
    normalize: bool = False
    heteroscedastic: bool = False
    groups: str = ""
    group_weight: float = 0.5
    haplotype_weight: float = 0.0
    haplotype_context: int = 3
    loo_weight: float = 0.0
    variance_penalty: float = 0.0
    dampen: float = 0.0
    rank_weight: float = 0.0
    rank_top: int = 0
    pairwise_weight: float = 0.0
    blend: str = "fixed"
    agree_scale: float = 1.5
    disagree_scale: float = 0.2
    #: Floor, pairwise weight and context from the data.
    auto_floor: bool = False
    auto_configure: bool = False
    spread_boost: bool = False
    #: Scale of exp(-distance / scale), by which switches prefer populations with close profiles; 0: none.
    closeness: float = 0.0
    #: Steps by distance (a map is an argument of paint), training, and the decoders' ways.
    window: int = 10_000
    distance_transitions: bool = False
    train_rounds: int = 0
    dampening: float = 0.0
    refine_passes: int = 0
    refine_weight: float = 0.5
    ensemble: int = 0
    ensemble_scale: float = 2.0
    sharpen: float = 0.0
    correct_short: int = 0
    entropy_smooth: int = 0
    majority_radius: int = 0
    majority_decay: float = 0.0
    smooth_min_windows: int = 0
    posterior_smooth: bool = False
    min_windows: int = 3
    min_len_bp: int = 10_000
    min_posterior: float = 0.0
    min_lod: float = 0.0


BLENDS = ("fixed", "adaptive", "agreement", "hybrid", "population", "population_hybrid")


def panel_rows(pairs: DataFrame, populations: DataFrame, queries: list[str], o: PaintOptions = PaintOptions()) -> DataFrame:
    """The panel in long form, weighted by purity and smoothed as the options say."""
    long = query_reference(pairs, queries, populations)
    if o.purity_power:
        long = P.weighted_by_purity(long, P.purity(long), o.purity_power)
    return P.smoothed(long, o.sims_context)


def observations(pairs: DataFrame, populations: DataFrame, queries: list[str], names: list[str], o: PaintOptions = PaintOptions(), mask: DataFrame | None = None, long: DataFrame | None = None) -> DataFrame:
    """sample, chrom, start_bp, end_bp, sims: one similarity a population, 0 without data."""
    seen = E.pivot(panel_rows(pairs, populations, queries, o) if long is None else long, names, o.emission_model, o.top)
    floor = identity_floor(seen) if o.auto_floor else o.identity_floor
    seen = seen.filter(F.array_max("sims") >= floor)
    return mask_out(seen, mask) if mask is not None else seen


def identity_floor(seen: DataFrame, cells: int = 10_000) -> float:
    """Where the windows' highest similarities have their largest gap below the first
    quartile, if that stands out of the spread; else the lower fence; never under .9; .995
    for under 20 windows. Values are met in cells of 1e-4, so the driver sees at most that
    many rows, and gaps inside a cell do not count."""
    best = seen.select(F.array_max("sims").alias("x"))
    n, top, q = best.agg(F.count(F.lit(1)), F.max("x"), F.expr("percentile(x, array(0.25, 0.75))")).first()
    if n < 20:
        return 0.995
    if top <= 0:
        return 0.9
    low = best.filter(F.col("x") <= q[0]).groupBy(F.floor(F.col("x") * cells).alias("cell")).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("cell").collect()
    gaps = [(b.lo - a.hi, b.lo) for a, b in zip(low, low[1:])]
    spread = q[1] - q[0]
    widest = max(gaps, default=(0.0, 0.0))
    return max(widest[1] if widest[0] > 1.5 * spread else q[0] - 1.5 * spread, 0.9)


def spread_ratio(seen: DataFrame, names: list[str]) -> float:
    """Widest over closest distance of population means, for three or more populations."""
    gaps = [r.gap for r in P.effect_sizes(seen, names).collect()]
    return max(gaps) / min(gaps) if len(gaps) >= 3 and min(gaps) > 0 else 1.0


def estimate_temperature(seen: DataFrame, k: int) -> float:
    """Mean of the upper quarter of the windows' spread over populations (at least two with
    data), within .0005 and .15; .03 without any. The quarter is cut by an exact
    percentile and a sum above it, so no window is sorted on one task."""
    some = F.filter("sims", lambda x: x > 0)
    spread = seen.select((F.array_max(some) - F.array_min(some)).alias("d"), F.size(some).alias("n")).filter("n >= 2 and d > 0").select("d")
    n = spread.count()
    if not n:
        return 0.03
    at = int(0.75 * n)
    cut = spread.agg(F.expr(f"percentile(d, {at / (n - 1) if n > 1 else 0.0!r})")).first()[0]
    above, total = spread.filter(F.col("d") > cut + 1e-15).agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0.0))).first()
    return min(max((total + (n - at - above) * cut) / (n - at), 0.0005), 0.15)


def estimate_switch(seen: DataFrame) -> float:
    """Rate of changes of the best population, 0.3 of it drawn to 0.001, within 1e-4 and .05;
    0.001 for under 10 windows."""
    w = Window.partitionBy(*KEYS).orderBy("start_bp")
    best = seen.withColumn("best", E.argmax(F.col("sims"))).withColumn("last", F.lag("best").over(w))
    n, steps, moved = best.agg(F.count(F.lit(1)), F.count("last"), F.count_if(F.col("last") != F.col("best"))).first()
    if n < 10 or not steps:
        return 0.001
    return min(max(0.3 * 0.001 + 0.7 * moved / steps, 1e-4), 0.05)


def emit(seen: DataFrame, k: int, temperature: float, o: PaintOptions, long: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """e: the log emissions after the options' models and transforms, in the JVM. Those that
    look at haplotypes need the panel in long form and the populations' names."""
    if o.blend not in BLENDS:
        raise ValueError(f"unknown blend {o.blend}")
    s = F.col("sims")
    parts = parse_groups(o.groups, names) if o.groups else None
    if o.normalize:
        stats = {r.population: r for r in P.normalization(seen, names).collect()}
        out = seen.withColumn("e", E.softmax_of(E.z_scores(s, [stats[n].mean for n in names], [stats[n].std for n in names]), temperature))
    elif parts:
        out = seen.withColumn("e", E.hierarchical(s, parts, temperature, o.group_weight))
    elif o.heteroscedastic:
        stats = {r.population: r for r in P.normalization(seen, names).collect()}
        out = seen.withColumn("e", E.softmax_by_state(s, E.state_temperatures(temperature, [stats[n].std for n in names])))
    else:
        out = seen.withColumn("e", E.log_softmax(s, temperature))
    if o.haplotype_weight:
        extra = P.bonus(long, names, o.haplotype_context, o.haplotype_weight, temperature)
        out = out.join(extra, P.WIN, "left").withColumn("e", F.when(F.col("bonus").isNull(), F.col("e")).otherwise(F.zip_with("e", "bonus", lambda x, y: x + y / temperature))).drop("bonus")
    if o.loo_weight:
        out = out.join(P.without_best(long, names, "mean" if o.emission_model == "mean" else "max"), P.WIN, "left")
        out = out.withColumn("e", F.when(F.col("sims_loo").isNull(), F.col("e")).otherwise(E.blend(F.col("e"), E.log_softmax(F.col("sims_loo"), temperature), o.loo_weight))).drop("sims_loo")
    if o.variance_penalty:
        out = out.join(P.window_variance(long, names), P.WIN, "left").withColumn("e", F.when(F.col("variance").isNull(), F.col("e")).otherwise(E.penalised(F.col("e"), F.col("variance"), o.variance_penalty))).drop("variance")
    if o.contrast:
        out = out.withColumn("e", E.contrast(F.col("e")))
    if o.dampen:
        out = E.dampen(out, KEYS, "e", o.dampen).withColumn("e", F.col("dampened")).drop("dampened")
    if o.rank_weight:
        out = out.join(P.rank_shares(long, names, o.rank_top, long.select("haplotype").distinct().count()), P.WIN, "left")
        out = out.withColumn("e", F.when(F.col("ranked").isNull(), F.col("e")).otherwise(E.blend(F.col("e"), F.col("ranked"), o.rank_weight))).drop("ranked")
    if o.consistency_weight:
        out = E.consistency(out, KEYS, "start_bp", "sims", k, o.consistency_context).withColumn("e", E.blend(F.col("e"), F.col("consistency"), o.consistency_weight)).drop("consistency")
    weight, context = o.pairwise_weight, o.emission_context
    if o.auto_configure:
        weight, context = P.configured([r.d for r in P.effect_sizes(seen, names).collect()], seen.count())
    if weight:
        out = E.pairwise(out, KEYS, "sims", k)
        pw = F.col("pairwise")
        if o.blend in ("adaptive", "hybrid", "population_hybrid"):
            out = out.join(E.upper_median(out, KEYS, E.margin(pw)), KEYS, "left")
        median = F.coalesce(F.col("median_margin"), F.lit(1.0)) if "median_margin" in out.columns else None
        if o.blend.startswith("population"):
            at = {n: i for i, n in enumerate(names)}
            sizes = {(at[r.a], at[r.b]): r.d for r in P.effect_sizes(seen, names).collect()}
            mixed = E.blend_looked_up(F.col("e"), pw, weight, *P.agreement_scales(sizes, k, seen.count(), o.agree_scale, o.disagree_scale), median)
        else:
            mixed = {
                "fixed": lambda: E.blend(F.col("e"), pw, weight), "adaptive": lambda: E.blend_adaptive(F.col("e"), pw, weight, median),
                "agreement": lambda: E.blend_agreement(F.col("e"), pw, weight, o.agree_scale, o.disagree_scale),
                "hybrid": lambda: E.blend_hybrid(F.col("e"), pw, weight, median, o.agree_scale, o.disagree_scale),
            }[o.blend]()
        out = out.withColumn("e", mixed).drop("pairwise", "median_margin")
    if context:
        out = E.smooth_arrays(out, KEYS, "start_bp", "e", k, context).withColumn("e", F.col("smooth")).drop("smooth")
    if o.label_smooth:
        out = out.withColumn("e", E.label_smooth(F.col("e"), o.label_smooth))
    return out


def with_steps(emitted: DataFrame, switch: float, o: PaintOptions, gmap: DataFrame | None = None) -> DataFrame:
    """s: each window's switch probability from the window before, by the map's distance, or
    by that of the starts over the window's size; null for a constant one."""
    if gmap is not None:
        placed = G.distances(emitted, gmap, KEYS, o.window)
        return placed.withColumn("s", G.modulated_switch(switch)).drop("mid", "cm", "cm_next", "step_bp", "step_cm")
    if not o.distance_transitions:
        return emitted.withColumn("s", F.lit(None).cast("double"))
    steps = (F.col("start_bp") - F.lag("start_bp").over(Window.partitionBy(*KEYS).orderBy("start_bp"))) / float(o.window)
    s = -F.expm1(F.log1p(F.lit(-float(switch))) * steps)
    return emitted.withColumn("s", F.least(F.lit(1 - 1e-10), F.greatest(F.lit(1e-10), s)))


def transitions(k: int, switch: float) -> np.ndarray:
    t = np.full((k, k), switch / max(1, k - 1))
    np.fill_diagonal(t, 1 - switch)
    return np.log(t)


def step_matrices(s: np.ndarray, k: int) -> np.ndarray:
    """Log matrices of switch probabilities: to each other state alike."""
    out = np.broadcast_to((s / max(1, k - 1))[:, None, None], (len(s), k, k)).copy()
    out[:, np.arange(k), np.arange(k)] = (1 - s)[:, None]
    return np.log(out)


def _pass(e, init, trans, lengths, k: int, o: PaintOptions):
    post, _ = chain.posteriors(e, init, trans, lengths)
    if o.decoding == "mpel":  # the best path over the posteriors
        return post, chain.viterbi(np.log(np.maximum(post, 1e-300)), init, trans, lengths)
    return post, chain.viterbi(e, init, trans, lengths) if o.decoding == "viterbi" else k - 1 - post[..., ::-1].argmax(-1)


def _ensemble(e, init, switch: float, lengths, k: int, o: PaintOptions):
    """Mean posteriors of members whose temperature and switch rate are spread over a factor."""
    total = 0.0
    for f in np.exp(np.linspace(-1, 1, o.ensemble) * math.log(o.ensemble_scale)) if o.ensemble > 1 else [1.0]:
        x = e / f
        top = x.max(-1, keepdims=True)
        x = x - top - np.log(np.exp(x - top).sum(-1, keepdims=True))
        trans = np.broadcast_to(transitions(k, min(switch * f, 0.5)), (len(e), k, k))
        total = total + chain.posteriors(x, init, trans, lengths)[0]
    post = total / o.ensemble
    return post, k - 1 - post[..., ::-1].argmax(-1)


def _retrained(e: np.ndarray, init: np.ndarray, trans: np.ndarray, k: int, switch: float, o: PaintOptions) -> np.ndarray:
    """Log transitions after one round of Baum-Welch over a sequence."""
    n = np.array([len(e)])
    alpha, _ = chain.forward(e[None], init[None], trans[None], n)
    beta = chain.backward(e[None], trans[None], n)
    xi = alpha[0, :-1, :, None] + trans[None] + (e + beta[0])[1:, None, :]
    xi = np.exp(xi - xi.max(axis=(1, 2), keepdims=True))
    moves = (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(0)
    return np.log(estimates.train_transitions(None, moves, np.exp(transitions(k, switch)), o.dampening))


def _decode(groups: list[pd.DataFrame], k: int, switch: float, o: PaintOptions, means: list[float] | None = None) -> pd.DataFrame:
    e, lengths = chain.stack([np.array(g["e"].tolist(), float) for g in groups])
    e = np.where(np.isfinite(e), e, -1e3)
    base = rules.population_aware(np.array(means), 1 - switch, o.closeness) if means and o.closeness and k > 1 else transitions(k, switch)
    init, trans = np.full((len(groups), k), -math.log(k)), np.broadcast_to(base, (len(groups), k, k))
    if groups[0]["s"].notna().any():
        steps = chain.stack([step_matrices(g["s"].to_numpy(float)[1:], k) for g in groups])[0]
        trans = steps if steps.shape[1] else trans
    for _ in range(o.train_rounds if trans.ndim == 3 else 0):
        trans = np.stack([_retrained(e[i, :n], init[i], trans[i], k, switch, o) for i, n in enumerate(lengths)])
    post, path = _ensemble(e, init, switch, lengths, k, o) if o.ensemble else _pass(e, init, trans, lengths, k, o)
    for turn in range(o.refine_passes):
        # What the last pass believed is added, with a weight that grows from pass to pass.
        weight = o.refine_weight * (turn + 1) / o.refine_passes
        post, path = _pass(e + weight * np.log(np.maximum(post, 1e-10)), init, trans, lengths, k, o)
    if o.two_pass or o.transforms or o.transition:
        chosen = {name: dict(params) for name, params in o.transforms}
        if chosen:
            e = e.copy()
            for i, n in enumerate(lengths):
                again = transforms.apply(e[i, :n], chosen, post[i, :n])
                e[i, :n] = np.where(np.isfinite(again), again, -1e3)
        if o.two_pass:
            shares = [estimates.proportions(path[i, :n], k) for i, n in enumerate(lengths)]
            init = np.log(np.stack(shares))
            trans = np.log(np.stack([estimates.proportional_transitions(p, estimates.switch_rates(path[i, :n], k)) for i, (p, n) in enumerate(zip(shares, lengths))]))
        if o.transition:
            name, params = o.transition
            if name not in RULES:
                raise ValueError(f"unknown transition rule {name}")
            if trans.ndim == 4:
                raise ValueError("a transition rule takes a constant switch rate, not steps by distance")
            rule = getattr(rules, name)
            steps = []
            for i, n in enumerate(lengths):
                have = {"post": post[i, :n], "states": path[i, :n], "e": e[i, :n]}
                steps.append(rule(trans[i], **{a: have[a] for a in have if a in rule.__code__.co_varnames[: rule.__code__.co_argcount]}, **dict(params)))
            trans = chain.stack(steps)[0]
        post, path = _pass(e, init, trans, lengths, k, o)
    out = []
    for i, (g, n) in enumerate(zip(groups, lengths)):
        s, p = path[i, :n], post[i, :n]
        if o.sharpen:
            p = p ** (1 / o.sharpen)
            p = p / p.sum(1, keepdims=True)
        if o.entropy_smooth:
            p = estimates.entropy_smooth(p, o.entropy_smooth)
        if o.majority_radius:
            s = estimates.majority(s, o.majority_radius, o.majority_decay)
        if o.posterior_smooth and o.smooth_min_windows:
            s = states.posterior_smooth(s, p, o.smooth_min_windows)
        elif o.smooth_min_windows:
            s = states.smooth(s, o.smooth_min_windows)
        if o.correct_short:
            s = states.correct_short(s, p, o.correct_short)
        out.append(g.drop(columns="s").assign(idx=np.arange(n), state=s, posteriors=list(p)))
    return pd.concat(out)


def decode_windows(emitted: DataFrame, k: int, switch: float, o: PaintOptions = PaintOptions(), means: list[float] | None = None) -> DataFrame:
    """Every window with its state and the posteriors of all; one shuffle by sample and
    chromosome, many sequences decoded at once. Samples of under 3 windows have none. means:
    the populations' mean similarities, for switches by closeness."""
    ship(emitted.sparkSession)
    schema = "sample string, chrom string, start_bp long, end_bp long, sims array<double>, e array<double>, idx int, state int, posteriors array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, ready, size = None, [], 0
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            cut = np.flatnonzero((rest[KEYS] != rest[KEYS].shift()).any(axis=1).to_numpy())
            for a, b in zip(cut, cut[1:]):
                if b - a >= 3:
                    ready.append(rest.iloc[a:b])
                    size += b - a
            rest = rest.iloc[cut[-1] :]
            if size >= BATCH_ROWS:
                yield _decode(ready, k, switch, o, means)
                ready, size = [], 0
        if rest is not None and len(rest) >= 3:
            ready.append(rest)
        if ready:
            yield _decode(ready, k, switch, o, means)

    rows = (emitted if "s" in emitted.columns else with_steps(emitted, switch, o)).select(*KEYS, "start_bp", "end_bp", "sims", "e", "s")
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "start_bp").mapInPandas(run, schema)


def segments_of(windows: DataFrame, names: list[str], o: PaintOptions = PaintOptions()) -> DataFrame:
    """Runs of one population with mean similarity, discriminability, posterior and LOD."""
    some = F.filter("sims", lambda x: x > 0)
    rated = windows.select(
        *KEYS, "start_bp", "end_bp", "state", F.array_max(some).alias("sim"), (F.array_max(some) - F.array_min(some)).alias("spread"),
        F.get("posteriors", F.col("state")).alias("p"), E.label_lod(F.col("e"), F.col("state")).alias("lod"),
    )
    w = Window.partitionBy(*KEYS).orderBy("start_bp")
    new = F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(1))
    island = rated.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = island.groupBy(*KEYS, "_run", "state").agg(
        F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp"), F.count(F.lit(1)).alias("n_windows"), F.avg("sim").alias("mean_similarity"),
        F.avg("p").alias("mean_posterior"), F.avg("spread").alias("discriminability"), F.sum("lod").alias("lod_score"),
    )
    kept = out.filter((F.col("n_windows") >= o.min_windows) & (F.col("end_bp") - F.col("start_bp") >= o.min_len_bp) & (F.col("mean_posterior") >= o.min_posterior) & (F.col("lod_score") >= o.min_lod))
    return kept.withColumn("ancestry", F.get(F.array(*map(F.lit, names)), F.col("state"))).drop("_run", "state")


def paint(pairs: DataFrame, populations: DataFrame, queries: list[str], o: PaintOptions = PaintOptions(), mask: DataFrame | None = None, gmap: DataFrame | None = None) -> DataFrame:
    """Segments of every query. Populations number by name; they are few and known to the driver."""
    names = sorted(r.population for r in populations.select("population").distinct().collect())
    return segments_of(painted(pairs, populations, queries, names, o, mask, gmap), names, o)


def painted(pairs: DataFrame, populations: DataFrame, queries: list[str], names: list[str], o: PaintOptions = PaintOptions(), mask: DataFrame | None = None, gmap: DataFrame | None = None) -> DataFrame:
    """Every window of every query with its state and the posteriors of all populations. With
    a genetic map, switches follow its distances."""
    long = panel_rows(pairs, populations, queries, o)
    seen = observations(pairs, populations, queries, names, o, mask, long)
    temperature = o.temperature or (normalized_temperature(seen, names) if o.normalize else estimate_temperature(seen, len(names)) if o.estimate else 0.03)
    if o.spread_boost and (ratio := spread_ratio(seen, names)) > 2:
        temperature = min(temperature * math.sqrt(ratio / 2), 0.15)
    switch = estimate_switch(seen) if o.estimate else o.switch
    emitted = with_steps(emit(seen, len(names), temperature, o, long, names), switch, o, gmap)
    means = None
    if o.closeness:
        by = {r.population: r.mean for r in P.normalization(seen, names).collect()}
        means = [by[n] for n in names]
    return decode_windows(emitted, len(names), switch, o, means)


def folds(populations: DataFrame, k: int) -> DataFrame:
    """fold of each reference haplotype, dealt out in turn by name within its population;
    populations of one haplotype are in no fold."""
    w = Window.partitionBy("population")
    return populations.withColumn("fold", F.when(F.count(F.lit(1)).over(w) >= 2, (F.row_number().over(w.orderBy("haplotype")) - 1) % max(k, 2)))


def cross_validate_folds(pairs: DataFrame, populations: DataFrame, names: list[str], k: int = 5, o: PaintOptions = PaintOptions()) -> DataFrame:
    """cross_validated over k folds: each fold's haplotypes are painted with the others. The
    panel is a list that the driver knows; a fold is one painting."""
    dealt = [(r.population, r.haplotype, r.fold) for r in folds(populations, k).collect()]
    parts = []
    for fold in range(max(k, 2)):
        tests = [h for _, h, f in dealt if f == fold]
        rest = [(p, h) for p, h, f in dealt if f != fold]
        if tests and rest:
            parts.append(painted(pairs, populations.sparkSession.createDataFrame(rest, "population string, haplotype string"), tests, names, o))
    if not parts:
        raise ValueError("no population has two haplotypes")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return cross_validated(every, populations, names)


def normalized_temperature(seen: DataFrame, names: list[str]) -> float:
    """As estimate_temperature for standardised similarities, within .5 and 5."""
    stats = {r.population: r for r in P.normalization(seen, names).collect()}
    z = seen.select(F.filter(E.z_scores(F.col("sims"), [stats[n].mean for n in names], [stats[n].std for n in names]), lambda x: x.isNotNull()).alias("z"))
    spread = z.filter("size(z) >= 2").select((F.array_max("z") - F.array_min("z")).alias("d")).filter("d > 0")
    cut = spread.agg(F.expr("percentile(d, 0.75)")).first()[0]
    if cut is None:
        return 1.0
    return min(max(spread.filter(F.col("d") >= cut).agg(F.avg("d")).first()[0], 0.5), 5.0)


def cross_validated(windows: DataFrame, populations: DataFrame, names: list[str]) -> DataFrame:
    """Of decoded windows whose samples are reference haplotypes themselves: windows, those
    given their own population, accuracy, precision, recall and f1 of each population with
    two or more haplotypes, and a row `overall` of all."""
    sizes = Window.partitionBy("population")
    own = populations.withColumn("_n", F.count(F.lit(1)).over(sizes)).filter("_n >= 2").select(F.col("haplotype").alias("sample"), F.col("population").alias("truth"))
    called = windows.join(own, "sample").select("truth", F.get(F.array(*map(F.lit, names)), F.col("state")).alias("called"))
    cells = called.groupBy("truth", "called").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("called"), F.col("n")).otherwise(0)
    ends = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("population"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), hit.alias("hit")), F.struct(F.col("called").alias("population"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = ends.groupBy("population").agg(F.sum("actual").alias("windows"), F.sum("called").alias("called"), F.sum("hit").alias("correct"))
    whole = per.agg(F.lit("overall").alias("population"), F.sum("windows").alias("windows"), F.sum("called").alias("called"), F.sum("correct").alias("correct"))
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    rated = per.unionByName(whole).withColumn("accuracy", ratio("correct", "windows")).withColumn("precision", ratio("correct", "called")).withColumn("recall", ratio("correct", "windows"))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def timing(segments: DataFrame, o: TimingOptions = TimingOptions(), per_sample: bool = False) -> DataFrame:
    """Pulses per population, pooled or for each sample, from the segments' lengths. Equal
    lengths are counted before the shuffle, so a fit gets the distinct ones, which are no
    more than the windows of a chromosome."""
    ship(segments.sparkSession)
    schema = "sample string, population string, n_tracts long, n_pulses int, pulse_idx int, generations double, proportion double, rate double, bic double, log_likelihood double, ks_statistic double, ks_rejected boolean"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pulses(pdf["length"].to_numpy(float), o, pdf["times"].to_numpy(float))
        base = {"sample": pdf["sample"].iloc[0], "population": pdf["ancestry"].iloc[0], "n_tracts": r["n_tracts"], "n_pulses": r["n_pulses"], "bic": r["bic"], "log_likelihood": r["log_likelihood"], "ks_statistic": r["ks_statistic"], "ks_rejected": r["rejected"]}
        rows = [base | {"pulse_idx": k, **p} for k, p in enumerate(r["pulses"])] or [base | {"pulse_idx": None, "generations": None, "proportion": None, "rate": None}]
        return pd.DataFrame(rows)

    length = segments.select(F.col("sample") if per_sample else F.lit("POOLED").alias("sample"), "ancestry", (F.col("end_bp") - F.col("start_bp")).alias("length"))
    return length.groupBy("sample", "ancestry", "length").agg(F.count(F.lit(1)).alias("times")).groupBy("sample", "ancestry").applyInPandas(fit, schema)
