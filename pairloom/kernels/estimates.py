"""Parameters of the K-state model from data, and its transition matrices."""

from __future__ import annotations

import math

import numpy as np


def proportions(states, k: int) -> np.ndarray:
    """Shares of the states, none below 1e-6 before they are made to sum to 1."""
    s = np.asarray(states, int)
    count = np.bincount(s[(s >= 0) & (s < k)], minlength=k).astype(float)
    share = np.maximum(count / max(1.0, count.sum()), 1e-6) if count.sum() else np.full(k, 1 / k)
    return share / share.sum()


def switch_rates(states, k: int) -> np.ndarray:
    """Per state: switches out of it over its windows, within 1e-4 and .05; .001 for under 10."""
    s = np.asarray(states, int)
    n = np.bincount(s, minlength=k)[:k]
    out = np.bincount(s[:-1][s[1:] != s[:-1]], minlength=k)[:k]
    return np.where(n < 10, 0.001, np.clip(out / np.maximum(n, 1), 1e-4, 0.05))


def proportional_transitions(share: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Row i stays with 1 - rate and switches in proportion to the other shares."""
    k = len(share)
    out = np.empty((k, k))
    for i in range(k):
        others = share.sum() - share[i]
        out[i] = rates[i] * share / others if others > 0 else rates[i] / max(1, k - 1)
        out[i, i] = 1 - rates[i]
    return out


def distance_transitions(starts: np.ndarray, window: int, k: int, switch: float) -> np.ndarray:
    """A log matrix for each step: the switch rate scaled by distance over window. None for
    under two windows or window 0."""
    if len(starts) < 2 or window <= 0:
        return np.empty((0, k, k))
    s = np.clip(-np.expm1(math.log1p(-switch) * np.diff(starts) / window), 1e-10, 1 - 1e-10)
    out = np.broadcast_to((s / max(1, k - 1))[:, None, None], (len(s), k, k)).copy()
    out[:, np.arange(k), np.arange(k)] = (1 - s)[:, None]
    return np.log(out)


def haldane(morgans):
    return 0.5 * -np.expm1(-2 * np.asarray(morgans, float))


def modulated_switch(base: float, cm: np.ndarray, bp: np.ndarray) -> np.ndarray:
    """The base rate times Haldane's map function of the map distance over that of the
    distance at 1 cM a megabase, within 1e-6 and .5."""
    nominal = haldane(np.asarray(bp, float) / 1e8)
    return np.clip(np.where(nominal > 0, base * haldane(np.asarray(cm, float) / 100) / np.maximum(nominal, 1e-300), base), 1e-6, 0.5)


def cohen_d(sims: np.ndarray) -> np.ndarray:
    """Effect size between populations' similarities, at most 100 where nothing varies."""
    m, v = sims.mean(0), sims.var(0, ddof=1)
    pooled = np.sqrt((v[:, None] + v[None]) / 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.abs(m[:, None] - m[None]) / pooled
    return np.minimum(np.where(pooled > 0, d, np.where(m[:, None] == m[None], 0.0, 100.0)), 100.0)


def auto_configure(sims: np.ndarray) -> tuple[float, int]:
    """Pairwise weight and emission context from the least effect size D between
    populations: context round(.1 / D) within 1 and 15; weight .7 cv min(D / .014, 1)
    min(sqrt(n / 5000), 1), at most .95, cv being 1 for two populations and else
    CV / (.4 + CV) of the effect sizes. (.3, 0) for under 10 windows."""
    n, k = sims.shape
    if n < 10 or k < 2:
        return 0.3, 0
    d = cohen_d(sims)[np.triu_indices(k, 1)]
    least = float(d.min())
    context = int(min(max(round(0.1 / least), 1), 15)) if least > 0 else 15
    spread = float(d.std() / d.mean()) if d.mean() > 0 else 0.0
    cv = 1.0 if k == 2 else spread / (0.4 + spread)
    return min(0.7 * cv * min(least / 0.014, 1) * min(math.sqrt(n / 5000), 1), 0.95), context


def panel_scale(temperature: float, haplotypes: float) -> float:
    """Less temperature for panels of more than ten haplotypes a population, within .001 and 1."""
    return temperature if haplotypes <= 1 else min(max(temperature / math.sqrt(1 + math.log(haplotypes / 10) / math.log(10)) if haplotypes > 1 and 1 + math.log(haplotypes / 10) / math.log(10) > 0 else temperature, 0.001), 1.0)


def population_scale(temperature: float, k: int) -> float:
    """Unchanged for three populations, less for more, within .001 and 1; one is left alone."""
    return temperature if k <= 1 else min(max(temperature * math.log(3) / math.log(max(k, 2)), 0.001), 1.0)


def train_transitions(posteriors, pairs, prior: np.ndarray, dampening: float = 0.0) -> np.ndarray:
    """Transitions from summed expected moves [k, k]: for two states symmetric, for more with
    the diagonal within .9 and .9999; dampening draws the result to the prior."""
    k = len(prior)
    row = pairs.sum(1, keepdims=True)
    new = np.where(row > 0, pairs / np.maximum(row, 1e-300), prior)
    if k == 2:
        s = float(np.clip((new[0, 1] + new[1, 0]) / 2, 1e-4, 0.1))
        new = np.array([[1 - s, s], [s, 1 - s]])
    else:
        stay = np.clip(np.diag(new), 0.9, 0.9999)
        off = new * (1 - np.eye(k))
        off = np.where(off.sum(1, keepdims=True) > 0, off / np.maximum(off.sum(1, keepdims=True), 1e-300), (1 - np.eye(k)) / (k - 1))
        new = off * (1 - stay)[:, None] + np.diag(stay)
    return (1 - dampening) * new + dampening * prior


def profiles(sims: np.ndarray, states: np.ndarray, k: int) -> np.ndarray:
    """Mean similarities of the windows that the first pass gave to each state."""
    return np.stack([sims[states == s].mean(0) if (states == s).any() else sims.mean(0) for s in range(k)])


def profile_emissions(sims: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """log-softmax of the correlation with each centre; ln(1/K) where nothing varies."""
    x = sims - sims.mean(1, keepdims=True)
    c = centres - centres.mean(1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
    r = np.where(norm > 1e-15, x @ c.T / np.maximum(norm, 1e-300), 0.0)
    return r - np.log(np.exp(r).sum(1, keepdims=True))


def entropy_smooth(post: np.ndarray, radius: int, beta: float = 2.0) -> np.ndarray:
    """Posteriors averaged over neighbours weighted by exp(beta (1 - entropy))."""
    h = -(post * np.log(np.maximum(post, 1e-12))).sum(1) / math.log(max(2, post.shape[1]))
    w = np.exp(beta * (1 - h))
    out = np.stack([np.average(post[max(0, t - radius) : t + radius + 1], axis=0, weights=w[max(0, t - radius) : t + radius + 1]) for t in range(len(post))])
    return out / out.sum(1, keepdims=True)


def majority(states: np.ndarray, radius: int, decay: float = 0.0) -> np.ndarray:
    """The commonest state around each window; with a decay, near ones count more."""
    s, k = np.asarray(states), int(np.max(states)) + 1
    out = s.copy()
    for t in range(len(s)):
        a, b = max(0, t - radius), min(len(s), t + radius + 1)
        w = np.exp(-decay * np.abs(np.arange(a, b) - t))
        votes = np.bincount(s[a:b], w, minlength=k)
        out[t] = s[t] if votes[s[t]] >= votes.max() else votes.argmax()
    return out
