"""Shared segments of all pairs: filters, one shuffle by pair, batched decoding, runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import coverage_ratio
from pairloom.kernels import two_state as K
from pairloom.operators.aggregates import contrast_adjust
from pairloom.operators.genmap import interpolate
from pairloom.operators.islands import composite_filter, merge_nearby, shared_segments
from pairloom.operators.rows import mask_out
from pairloom.shipping import ship

KEYS = ["chrom", "hap_a", "hap_b"]
BATCH_ROWS = 100_000


@dataclass(frozen=True)
class PairOptions:
    """Options of the detection, with their defaults."""

    window: int = 10_000
    min_len_bp: int = 2_000_000
    min_windows: int | None = None
    expected_windows: float = 50
    enter: float = 1e-4
    population: str = "GENERIC"
    posterior_threshold: float = 0.0
    min_lod: float | None = 3.0
    rounds: int = 20
    adaptive_transitions: bool = False
    identity_floor: float = 0.9
    emission_context: int = 0
    bridge_gaps: int = 0
    bridge_posterior: float = 0.3
    composite: bool = False
    composite_threshold: float = 0.3
    adaptive_bridge: bool = False
    adaptive_refinement: bool = False
    adaptive_emission: bool = False
    multi_scale: bool = False
    contrast: bool = False
    k0_feature: bool = False
    k0_threshold: float = 0.9999
    distance_transitions: bool = False
    #: Training sees the steps by distance, or by the genetic map, too.
    trained_steps: bool = False
    logit_emissions: bool = False
    coverage_feature: bool = False

    def least_windows(self) -> int:
        return self.min_windows or max(self.min_len_bp // self.window, 1)


def _decode(groups: list[pd.DataFrame], o: PairOptions) -> pd.DataFrame:
    pop = K.population(o.population)
    xs = [g["identity"].to_numpy(float) for g in groups]
    if o.logit_emissions:
        xs = [K.logit(x) for x in xs]
    start = K.Params.of(pop, o.expected_windows, o.enter, o.window, o.adaptive_transitions, o.logit_emissions)
    params = [K.robust(start, x, pop, o.window, o.logit_emissions) for x in xs]
    if o.adaptive_emission:
        params = [K.replace(p, high=K.Gauss(p.high.mean, _top_std(x) or p.high.std)) for p, x in zip(params, xs)]
    extra = None
    if o.coverage_feature:
        # Fixed before training, from the posteriors of the first parameters.
        first = K.decode(params, [p.emissions(x) for p, x in zip(params, xs)])
        extra = [K.side_emissions(g["coverage"].to_numpy(float), post) for g, (_, post) in zip(groups, first)]
    step_of = None
    if "cm" in groups[0]:
        step_of = lambda k, p: K.map_transitions(p, (groups[k]["start_bp"].to_numpy() + groups[k]["end_bp"].to_numpy()) // 2, groups[k]["cm"].to_numpy(float), groups[k]["cm_next"].to_numpy(float), o.window)
    elif o.distance_transitions:
        step_of = lambda k, p: K.distance_transitions(p, groups[k]["start_bp"].to_numpy(), groups[k]["end_bp"].to_numpy())
    if o.rounds:
        params = K.train(params, xs, pop, o.window, o.rounds, in_logits=o.logit_emissions, extra=extra, step_of=step_of if o.trained_steps else None)
    emits = [p.emissions(x) + (extra[k] if extra else 0.0) for k, (p, x) in enumerate(zip(params, xs))]
    steps = [step_of(k, p) for k, p in enumerate(params)] if step_of else None
    if o.k0_feature:
        for k, (_, post) in enumerate(K.decode(params, emits, steps)):
            hit = (groups[k]["raw_identity"].to_numpy(float) >= o.k0_threshold).astype(float)
            p0, p1 = K.shared_rates(hit, post)
            if p1 > p0:
                emits[k] = emits[k] + np.where(hit[:, None] > 0.5, np.log([p0, p1]), np.log([1 - p0, 1 - p1]))
    if o.emission_context:
        emits = [K.smooth_rows(e, o.emission_context) for e in emits]
    out = []
    for g, p, x, (states, post) in zip(groups, params, xs, K.decode(params, emits, steps)):
        if o.multi_scale:
            states = K.multi_scale(p, x, states, post)
        elif o.rounds:
            states = K.refine(states, post)
        if o.adaptive_refinement:
            states = K.refine_adaptive(states, post)
        if o.bridge_gaps:
            states = K.bridge(states, post, o.bridge_gaps, o.bridge_posterior, o.adaptive_bridge)
            states = K.refine_adaptive(states, post) if o.adaptive_refinement else K.refine(states, post)
        e = p.emissions(x)
        out.append(g[["chrom", "start_bp", "end_bp", "hap_a", "hap_b", "identity"]].assign(idx=np.arange(len(g)), state=states, posterior=post, lod=(e[:, 1] - e[:, 0]) / math.log(10)))
    return pd.concat(out)


def _top_std(x: np.ndarray) -> float | None:
    """Deviation of the highest twentieth, within bounds; None for under 20 values."""
    if len(x) < 20:
        return None
    return K.clamp(float(np.sort(x)[-max(5, math.ceil(len(x) * 0.05)) :].std()), 0.0003, 0.002)


_WINDOWS = "chrom string, start_bp long, end_bp long, hap_a string, hap_b string, identity double, idx int, state int, posterior double, lod double"


def decode_windows(pairs: DataFrame, options: PairOptions = PairOptions(), mask: DataFrame | None = None, gmap: DataFrame | None = None) -> DataFrame:
    """Every window of every pair of three or more windows, with state, posterior and LOD.

    One shuffle brings a pair's windows together in order; a task reads whole pairs off
    its sorted rows and decodes many at once, so its memory holds a batch of pairs."""
    o = options
    ship(pairs.sparkSession)
    rows = pairs.filter(F.col("identity") >= o.identity_floor)
    if mask is not None:
        rows = mask_out(rows, mask)
    rows = rows.withColumn("raw_identity", F.col("identity"))
    if o.contrast:
        rows = contrast_adjust(rows).withColumn("identity", F.col("adjusted")).drop("adjusted")
    coverage = coverage_ratio("a_length", "b_length") if o.coverage_feature else F.lit(0.0)
    rows = rows.select("chrom", "start_bp", "end_bp", "hap_a", "hap_b", F.col("identity").cast("double"), F.col("raw_identity").cast("double"), coverage.cast("double").alias("coverage"))
    if gmap is not None:
        middle = F.floor((F.col("start_bp") + F.col("end_bp")) / 2).cast("long")
        placed = interpolate(interpolate(rows.withColumn("mid", middle).withColumn("_next", middle + o.window), gmap, "mid", "cm"), gmap, "_next", "cm_next")
        rows = placed.drop("mid", "_next")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, ready, size = None, [], 0
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            change = (rest[KEYS] != rest[KEYS].shift()).any(axis=1).to_numpy()
            cut = np.flatnonzero(change)
            for a, b in zip(cut, cut[1:]):
                if b - a >= 3:
                    ready.append(rest.iloc[a:b])
                    size += b - a
            rest = rest.iloc[cut[-1] :]
            if size >= BATCH_ROWS:
                yield _decode(ready, o)
                ready, size = [], 0
        if rest is not None and len(rest) >= 3:
            ready.append(rest)
        if ready:
            yield _decode(ready, o)

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "start_bp", "end_bp").mapInPandas(run, _WINDOWS)


def segments_of(windows: DataFrame, options: PairOptions = PairOptions()) -> DataFrame:
    """Shared segments of decoded windows, filtered as the options say. A segment's mean
    identity, gaps that were bridged included, is a difference of running sums, so the
    windows are read once."""
    o = options
    w = Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = windows.withColumn("_upto", F.sum("identity").over(w)).withColumn("_before", F.col("_upto") - F.col("identity"))
    ends = lambda: (F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp"), F.min("_before").alias("_before"), F.max("_upto").alias("_upto"))
    found = shared_segments(summed, KEYS, "idx", "state", "posterior", "lod", 1 if o.composite else o.least_windows(), 0.0 if o.composite else o.posterior_threshold, None if o.composite else o.min_lod, ends())
    found = found.withColumnRenamed("first_pos", "start_idx").withColumnRenamed("last_pos", "end_idx")
    if o.composite:
        found = composite_filter(found, o.least_windows(), max(o.least_windows() // 10, 5), o.composite_threshold)
    if o.bridge_gaps:
        found = merge_nearby(found, KEYS, o.bridge_gaps, extra=ends())
    out = found.withColumn("mean_identity", (F.col("_upto") - F.col("_before")) / (F.col("end_idx") - F.col("start_idx") + 1))
    return out.filter(F.col("end_bp") - F.col("start_bp") >= o.min_len_bp).drop("start_idx", "end_idx", "_before", "_upto")


def detect_shared(pairs: DataFrame, options: PairOptions = PairOptions(), mask: DataFrame | None = None, gmap: DataFrame | None = None) -> DataFrame:
    """Shared segments of every pair. With a genetic map (chrom, bp, cm) transitions follow
    its distances."""
    return segments_of(decode_windows(pairs, options, mask, gmap), options)
