"""Transforms of log emissions of one sequence ([windows, populations], -inf: no data).

SPECIFIED ones follow published formulas. INFERRED ones follow one sentence of
description each; their exact constants are our choice, and no parity is claimed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

SPECIFIED: dict[str, Callable] = {}
INFERRED: dict[str, Callable] = {}
#: The order in which second-pass transforms apply; they do not commute.
ORDER = (
    "whiten", "rank_transform", "outlier_dampen", "momentum", "pop_temperature", "snr", "detrend", "variance_stabilize", "kurtosis", "gap_penalty", "center",
    "median_polish", "softmax_renormalize", "window_normalize", "quantile_normalize", "local_rerank", "bayesian_shrink", "sparsify", "proportion_prior", "confidence",
    "fb_temperature", "persistence", "posterior_feedback", "focused_mask", "label_smooth", "posterior_blend", "floor", "diversity", "residual", "anchor", "gradient",
    "changepoint", "pairwise_contrast", "margin_persistence", "flank",
)


def _add(registry):
    def add(f):
        registry[f.__name__] = f
        return f

    return add


specified, inferred = _add(SPECIFIED), _add(INFERRED)


def finite_mean(e: np.ndarray, axis: int) -> np.ndarray:
    ok = np.isfinite(e)
    return np.where(ok, e, 0.0).sum(axis, keepdims=True) / np.maximum(ok.sum(axis, keepdims=True), 1)


def on_finite(e: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(e), new, e)


def gap(e: np.ndarray) -> np.ndarray:
    """Highest less second highest finite entry of each window."""
    s = np.sort(np.where(np.isfinite(e), e, -1e30), axis=1)
    return np.where(np.isfinite(e).sum(1) >= 2, s[:, -1] - s[:, -2], 0.0)


def log_softmax(e: np.ndarray) -> np.ndarray:
    top = e.max(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return e - top - np.log(np.exp(e - top).sum(1, keepdims=True))


def frames(n: int, r: int) -> list[slice]:
    return [slice(max(0, i - r), i + r + 1) for i in range(n)]


@specified
def center(e):
    """Less the window's mean of finite entries."""
    return on_finite(e, e - finite_mean(e, 1))


@specified
def smooth_context(e, context: int = 1):
    """Mean over the windows up to `context` away."""
    return np.stack([e[f].mean(0) for f in frames(len(e), context)]) if len(e) else e


@specified
def smooth_weighted(e, context: int = 1):
    """The same, windows weighted by their gap; plain where no gap is positive."""
    w = gap(e)
    return np.stack([np.average(e[f], axis=0, weights=w[f] if w[f].sum() > 0 else None) for f in frames(len(e), context)]) if len(e) else e


@specified
def consistency(e, context: int = 2):
    """ln((wins + .5) / (n + 1)) around each window; ties share a win."""
    best = (e == e.max(1, keepdims=True)) & np.isfinite(e)
    wins = best / np.maximum(best.sum(1, keepdims=True), 1)
    return np.stack([np.log((wins[f].sum(0) + 0.5) / (len(wins[f]) + 1)) for f in frames(len(e), context)])


@specified
def floor(e, least: float = -20.0):
    return np.maximum(e, least)


@specified
def label_smooth(e, a: float = 0.1):
    return (1 - a) * e + a * math.log(1 / e.shape[1])


@inferred
def whiten(e, reg: float = 1e-6):
    """Decorrelates the populations by the inverse root of their covariance."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    d, v = np.linalg.eigh(np.cov(x.T) + reg * np.eye(e.shape[1]))
    m = x.mean(0)
    return on_finite(e, (x - m) @ v @ np.diag(1 / np.sqrt(np.maximum(d, reg))) @ v.T + m)


@inferred
def rank_transform(e):
    return on_finite(e, (e[:, :, None] > e[:, None, :]).sum(2).astype(float))


@inferred
def outlier_dampen(e, mads: float = 3.0):
    """Clips each population at its median -+ mads median absolute deviations."""
    x = np.where(np.isfinite(e), e, np.nan)
    m = np.nanmedian(x, 0)
    d = np.nanmedian(np.abs(x - m), 0)
    return on_finite(e, np.clip(e, m - mads * d, m + mads * d))


@inferred
def momentum(e, a: float = 0.3):
    """Mean of forward and backward exponential averages."""
    f, b = e.copy(), e.copy()
    for t in range(1, len(e)):
        f[t] = (1 - a) * e[t] + a * f[t - 1]
        b[-1 - t] = (1 - a) * e[-1 - t] + a * b[-t]
    return (f + b) / 2


@inferred
def snr(e, power: float = 1.0):
    """Scales what lies above the mean by each population's signal-to-noise ratio."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    ratio = np.abs(x.mean(0) - x.mean()) / np.maximum(x.std(0), 1e-9)
    m = finite_mean(e, 1)
    return on_finite(e, m + (e - m) * (ratio / max(ratio.mean(), 1e-9)) ** power)


@inferred
def detrend(e):
    """Removes each population's least-squares line over the windows."""
    t = np.arange(len(e)) - (len(e) - 1) / 2
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    return on_finite(e, e - np.outer(t, t @ x / max(float(t @ t), 1e-12)))


@inferred
def variance_stabilize(e):
    """Brings the populations' deviations to their median."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    s = np.maximum(x.std(0), 1e-9)
    return on_finite(e, x.mean(0) + (x - x.mean(0)) * np.median(s) / s)


@inferred
def kurtosis(e, weight: float = 0.5):
    """Less weight to populations with heavy tails."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    return on_finite(e, e / (1 + weight * np.maximum((z**4).mean(0) - 3, 0) / 3))


@inferred
def gap_penalty(e, weight: float = 0.5):
    """Subtracts each population's mean jump between neighbours."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    return e - weight * np.abs(np.diff(x, axis=0)).mean(0) if len(e) > 1 else e


@inferred
def median_polish(e, rounds: int = 10):
    """Residuals of windows' and populations' medians."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    for _ in range(rounds):
        x = x - np.median(x, 1, keepdims=True)
        x = x - np.median(x, 0, keepdims=True)
    return on_finite(e, x)


@inferred
def softmax_renormalize(e, temperature: float = 1.0):
    return log_softmax(e / temperature)


@inferred
def window_normalize(e, radius: int = 5):
    return on_finite(e, e - np.stack([finite_mean(e[f], 0)[0] for f in frames(len(e), radius)]))


@inferred
def quantile_normalize(e):
    """Gives every population the same distribution over the windows."""
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    order = x.argsort(0, kind="stable")
    level = np.sort(x, 0).mean(1)
    out = np.empty_like(x)
    np.put_along_axis(out, order, np.broadcast_to(level[:, None], x.shape), 0)
    return on_finite(e, out)


@inferred
def local_rerank(e, radius: int = 5):
    """Ranks populations by their summed emissions around each window."""
    x = np.where(np.isfinite(e), e, -50.0)
    return rank_transform(np.stack([x[f].sum(0) for f in frames(len(e), radius)]))


@inferred
def bayesian_shrink(e, weight: float = 0.2):
    return on_finite(e, (1 - weight) * e + weight * finite_mean(e, 0))


@inferred
def sparsify(e, k: int = 2, low: float = -100.0):
    return np.where(e >= -np.sort(-e, axis=1)[:, min(k, e.shape[1]) - 1 : min(k, e.shape[1])], e, low)


@inferred
def proportion_prior(e, weight: float = 1.0, shares=None):
    p = np.maximum(np.full(e.shape[1], 1 / e.shape[1]) if shares is None else np.asarray(shares, float), 1e-6)
    return e + weight * np.log(p)


@inferred
def confidence(e, power: float = 0.5):
    return on_finite(e, e * gap(e)[:, None] ** power)


@inferred
def fb_temperature(e, temperature: float = 1.0):
    return e / temperature


@inferred
def pop_temperature(e, posteriors=None, scale: float = 1.0):
    """Populations with a high mean posterior get a lower temperature."""
    p = np.exp(log_softmax(e)) if posteriors is None else posteriors
    return on_finite(e, e / (1 + scale * (1 / e.shape[1] - p.mean(0))))


def _first(e, posteriors):
    p = np.exp(log_softmax(e)) if posteriors is None else posteriors
    return p, p.shape[1] - 1 - p[:, ::-1].argmax(1)


@inferred
def persistence(e, posteriors=None, bonus: float = 0.5):
    """A bonus on the first pass's state."""
    out = e.copy()
    out[np.arange(len(e)), _first(e, posteriors)[1]] += bonus
    return out


@inferred
def changepoint(e, posteriors=None, bonus: float = 0.3):
    """A smaller bonus on the first pass's state."""
    return persistence(e, posteriors, bonus)


@inferred
def posterior_feedback(e, posteriors=None, weight: float = 0.5):
    p, _ = _first(e, posteriors)
    return e + weight * (p - 1 / p.shape[1])


@inferred
def focused_mask(e, posteriors=None, threshold: float = 0.05):
    p, _ = _first(e, posteriors)
    second = np.sort(p, 1)[:, -min(2, p.shape[1])][:, None]
    return np.where((p >= threshold) | (p >= second), e, -np.inf)


@inferred
def posterior_blend(e, posteriors=None, weight: float = 0.3):
    p, _ = _first(e, posteriors)
    return (1 - weight) * e + weight * np.log(np.maximum(p, 1e-10))


@inferred
def diversity(e, amplify: float = 0.5, dampen: float = 0.5):
    """Widens windows of low entropy and narrows those of high entropy."""
    p = np.exp(log_softmax(e))
    h = -(p * np.log(np.maximum(p, 1e-12))).sum(1, keepdims=True) / math.log(max(2, e.shape[1]))
    m = finite_mean(e, 1)
    return on_finite(e, m + (e - m) * (1 + amplify * (1 - h) - dampen * h))


@inferred
def residual(e, factor: float = 1.5):
    m = finite_mean(e, 1)
    return on_finite(e, m + factor * (e - m))


@inferred
def anchor(e, radius: int = 3, threshold: float = 0.6, strength: float = 0.5):
    """A boost where the neighbourhood agrees on the best population."""
    best, out = e.argmax(1), e.copy()
    for t, f in enumerate(frames(len(e), radius)):
        if (best[f] == best[t]).mean() >= threshold:
            out[t, best[t]] += strength
    return out


@inferred
def gradient(e, weight: float = 0.3):
    """Damps large changes from the window before."""
    out = e.copy()
    x = np.where(np.isfinite(e), e, finite_mean(e, 0))
    out[1:] = on_finite(e[1:], e[1:] - weight * np.diff(x, axis=0))
    return out


@inferred
def pairwise_contrast(e, weight: float = 0.3):
    """Widens the gap of the two best."""
    out, g = e.copy(), gap(e)
    out[np.arange(len(e)), e.argmax(1)] += weight * g
    return out


@inferred
def margin_persistence(e, posteriors=None, bonus: float = 0.5, threshold: float = 0.5):
    """A bonus on the first pass's state, growing with its margin above the threshold."""
    p, best = _first(e, posteriors)
    s = np.sort(p, 1)
    m = s[:, -1] - (s[:, -2] if p.shape[1] > 1 else 0)
    out = e.copy()
    out[np.arange(len(e)), best] += bonus * np.clip((m - threshold) / max(1e-9, 1 - threshold), 0, 1)
    return out


@inferred
def flank(e, posteriors=None, radius: int = 3, bonus: float = 0.5):
    """A bonus where both flanks' majorities agree."""
    _, best = _first(e, posteriors)
    k, out = e.shape[1], e.copy()
    for t in range(radius, len(e) - radius):
        left, right = (np.bincount(best[a:b], minlength=k).argmax() for a, b in ((t - radius, t), (t + 1, t + radius + 1)))
        if left == right:
            out[t, left] += bonus
    return out


def apply(e: np.ndarray, chosen: dict[str, dict], posteriors: np.ndarray | None = None) -> np.ndarray:
    """The chosen transforms in the second pass's order."""
    unknown = set(chosen) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown transforms: {', '.join(sorted(unknown))}")
    for name in ORDER:
        if name in chosen:
            f = SPECIFIED.get(name) or INFERRED[name]
            more = {"posteriors": posteriors} if "posteriors" in f.__code__.co_varnames[: f.__code__.co_argcount] else {}
            e = f(e, **more, **chosen[name])
    return e
