"""Admixture timing from tract lengths: exponential mixtures over a detection limit."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Critical factors of the Kolmogorov-Smirnov test by significance.
KS_FACTORS = ((0.01, 1.63), (0.05, 1.36), (1.0, 1.22))


@dataclass(frozen=True)
class TimingOptions:
    recombination: float = 1e-8
    least_bp: float = 20_000.0
    max_pulses: int = 3
    tolerance: float = 1e-8
    rounds: int = 200
    alpha: float = 0.05
    mean_rate: float | None = None


def single(x: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Rate and log likelihood of one exponential over excess lengths with their counts."""
    n, total = w.sum(), (w * x).sum()
    rate = n / total
    return rate, n * math.log(rate) - rate * total


def ks(x: np.ndarray, alpha: float, w: np.ndarray | None = None) -> tuple[float, float]:
    """Largest distance of the empirical from the fitted distribution, and its critical value."""
    w = np.ones(len(x)) if w is None else w
    n = w.sum()
    if not n:
        return 0.0, 1.0
    order = np.argsort(x, kind="stable")
    x, w = np.maximum(x[order], 0.0), w[order]
    model = -np.expm1(-(n / (w * x).sum()) * x)
    upto = np.cumsum(w)
    # Only the ends of a stretch of equal lengths can be the farthest.
    last, first = np.r_[x[1:] != x[:-1], True], np.r_[True, x[1:] != x[:-1]]
    d = max(np.abs(upto[last] / n - model[last]).max(), np.abs((upto - w)[first] / n - model[first]).max())
    return float(d), next(f for a, f in KS_FACTORS if alpha <= a) / math.sqrt(n)


def exponential_mixture(x: np.ndarray, m: int, o: TimingOptions, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Shares, rates (ascending) and log likelihood of m exponentials by EM."""
    w = np.ones(len(x)) if w is None else w
    by = np.argsort(x, kind="stable")
    ordered, upto, n = x[by], np.cumsum(w[by]), int(w.sum())
    edges = np.minimum((n * np.arange(m + 1) / (m + 1)).astype(int), n)
    middle = ordered[np.searchsorted(upto, n // 2, side="right")]

    def start(a: int, b: int) -> float:
        inside = np.clip(np.minimum(upto, b) - np.maximum(upto - w[by], a), 0, None)
        return inside.sum() / (inside * np.maximum(ordered, 1.0)).sum() if inside.sum() else 1 / max(middle, 1.0)

    rates = np.sort([start(a, b) for a, b in zip(edges, edges[1:])])
    for k in range(1, m):
        if rates[k] <= rates[k - 1]:
            rates[k] = rates[k - 1] * 1.5
    share, last = np.full(m, 1 / m), -math.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(o.rounds):
            dens = share * rates * np.exp(-np.outer(x, rates))
            total = dens.sum(1, keepdims=True)
            resp = np.where(total > 0, dens / total, 1 / m) * w[:, None]
            size, mass = resp.sum(0), resp.T @ x
            share = np.maximum(size / n, 1e-10)
            rates = np.where((mass > 0) & (size > 0), size / mass, rates)
            share = share / share.sum()
            if o.mean_rate:
                rates = np.maximum(rates + (o.mean_rate - share @ rates) / (share @ share) * share, 1e-15)
            order = np.argsort(rates, kind="stable")
            rates, share = rates[order], share[order]
            ll = float((w * np.log((share * rates * np.exp(-np.outer(x, rates))).sum(1))).sum())
            if abs(ll - last) < o.tolerance:
                break
            last = ll
    return share, rates, ll


def pulses(lengths: np.ndarray, o: TimingOptions = TimingOptions(), times: np.ndarray | None = None) -> dict:
    """One to three pulses: more than one needs the test to reject a single exponential, 20
    tracts, 10 for each pulse, a lower BIC and rates apart by over half. times: how often
    each length occurs."""
    x = np.asarray(lengths, float)
    w = np.ones(len(x)) if times is None else np.asarray(times, float)
    every = int(w.sum())
    x, w = x[x > o.least_bp] - o.least_bp, w[x > o.least_bp]
    n = int(w.sum())
    none = {"n_tracts": n if every >= 3 else every, "n_pulses": 0, "pulses": [], "bic": math.inf, "log_likelihood": -math.inf, "ks_statistic": None, "rejected": False}
    if every < 3 or n < 3:
        return none
    rate, ll = single(x, w)
    best = (-2 * ll + math.log(n), ll, np.ones(1), np.array([rate]))
    d, critical = ks(x, o.alpha, w)
    if d > critical and n >= 20:
        for m in range(2, min(o.max_pulses, 3) + 1):
            if n < 10 * m:
                break
            share, rates, ll = exponential_mixture(x, m, o, w)
            bic = -2 * ll + (2 * m - 1) * math.log(n)
            if math.isfinite(ll) and bic < best[0] and rates[-1] / rates[0] > 1.5:
                best = (bic, ll, share, rates)
    found = [{"generations": r / o.recombination, "proportion": float(p), "rate": float(r)} for p, r in zip(best[2], best[3])]
    return {"n_tracts": n, "n_pulses": len(found), "pulses": found, "bic": best[0], "log_likelihood": best[1], "ks_statistic": d, "rejected": bool(d > critical)}


def report(rows: list[dict]) -> str:
    """Text of timing() rows: a line a pulse under a line a sample and population."""
    out, last = [], None
    for r in sorted(rows, key=lambda r: (r["sample"], r["population"], r["pulse_idx"] or 0)):
        if (r["sample"], r["population"]) != last:
            last = (r["sample"], r["population"])
            out.append(f"{r['sample']} {r['population']}: {r['n_tracts']} tracts, {r['n_pulses']} pulses, KS {'-' if r['ks_statistic'] is None else format(r['ks_statistic'], '.4f')}{' (rejected)' if r['ks_rejected'] else ''}")
        if r["pulse_idx"] is not None:
            out.append(f"  pulse {r['pulse_idx'] + 1}: {r['generations']:.1f} generations, {100 * r['proportion']:.1f} %, rate {r['rate']:.3g}")
    return "\n".join(out)
