"""Further emission models and decoders of the K-state model, on arrays of one sequence.

sims: [windows, haplotypes] with 0 for no data; groups: the population of each haplotype."""

from __future__ import annotations

import math

import numpy as np

from pairloom.kernels import chain
from pairloom.kernels.transforms import frames, gap, log_softmax


def aggregate(sims: np.ndarray, groups: np.ndarray, k: int, how: str = "max", top: int = 2, decay: float = 1.0) -> np.ndarray:
    """One similarity a population: max, mean, median or (decay-weighted) mean of the top ones."""
    out = np.zeros((len(sims), k))
    for p in range(k):
        own = -np.sort(-np.where(sims[:, groups == p] > 0, sims[:, groups == p], -np.inf), axis=1)
        n = np.isfinite(own).sum(1)
        for t in np.flatnonzero(n):
            x = own[t, : n[t]]
            if how == "top":
                w = decay ** np.arange(min(top, len(x)))
                out[t, p] = (x[: len(w)] * w).sum() / w.sum() if top else 0.0
            else:
                out[t, p] = {"max": x[0], "mean": x.mean(), "median": np.median(x)}[how]
    return out


def softmax_emissions(values: np.ndarray, temperature) -> np.ndarray:
    """log-softmax over entries above 0; -inf elsewhere; temperature may differ by population."""
    return log_softmax(np.where(values > 0, values / np.asarray(temperature, float), -np.inf))


def smooth_sims(sims: np.ndarray, context: int) -> np.ndarray:
    """Each haplotype's mean over the windows around in which it is present."""
    out = sims.astype(float).copy()
    for t, f in enumerate(frames(len(sims), context)):
        x = sims[f]
        n = (x > 0).sum(0)
        out[t] = np.where((sims[t] > 0) & (n > 0), x.sum(0) / np.maximum(n, 1), sims[t])
    return out


def haplotype_bonus(sims: np.ndarray, groups: np.ndarray, k: int, context: int, weight: float, temperature: float) -> np.ndarray:
    """weight x temperature x the share of neighbouring windows with the same best haplotype,
    for that haplotype's population."""
    best, out = sims.argmax(1), np.zeros((len(sims), k))
    for t, f in enumerate(frames(len(sims), context)):
        around = np.delete(best[f], t - f.start)
        if len(around) and sims[t].max() > 0:
            out[t, groups[best[t]]] = weight * temperature * (around == best[t]).mean()
    return out


def rank_emissions(sims: np.ndarray, groups: np.ndarray, k: int, top: int = 0) -> np.ndarray:
    """ln of each population's share among the top ranked haplotypes, with half a pseudo-count;
    top 0 takes as many as a population has on average."""
    top = top or max(1, len(groups) // k)
    ranked = np.argsort(-sims, axis=1, kind="stable")[:, :top]
    share = np.stack([(groups[ranked] == p).sum(1) for p in range(k)], 1) + 0.5
    return np.log(share / share.sum(1, keepdims=True))


def hierarchical_emissions(values: np.ndarray, parts: list[list[int]], temperature: float, weight: float = 0.5) -> np.ndarray:
    """A softmax over groups of populations and one within each group, blended."""
    group = softmax_emissions(np.stack([values[:, p].max(1) for p in parts], 1), temperature)
    out = np.full(values.shape, -np.inf)
    for g, p in enumerate(parts):
        inner = softmax_emissions(values[:, p], temperature) if len(p) > 1 else np.where(values[:, p] > 0, 0.0, -np.inf)
        out[:, p] = weight * group[:, [g]] + (1 - weight) * inner
    return log_softmax(out)


def parse_groups(spec: str, names: list[str]) -> list[list[int]]:
    """A,B;C as lists of numbers; every population once."""
    parts = [[names.index(n.strip()) for n in part.split(",")] for part in spec.split(";") if part.strip()]
    if sorted(i for p in parts for i in p) != list(range(len(names))):
        raise ValueError("groups must have every population once")
    return parts


def detect_groups(means: np.ndarray, threshold: float) -> list[list[int]]:
    """Single linkage of populations nearer than, but not as near as 0 to, a threshold; each
    alone for two or fewer."""
    k = len(means)
    label = list(range(k))
    if k > 2:
        for i in range(k):
            for j in range(i):
                if 0 < abs(means[i] - means[j]) < threshold:
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
    return [[i for i in range(k) if label[i] == g] for g in dict.fromkeys(label)]


def pairwise_emissions(values: np.ndarray) -> np.ndarray:
    """Bradley-Terry: each population's mean log odds against every other, with a temperature
    for each pair from the spread of their difference."""
    n, k = values.shape
    score = np.zeros((n, k))
    for i in range(k):
        for j in range(k):
            if i != j:
                d = np.where((values[:, i] > 0) & (values[:, j] > 0), values[:, i] - values[:, j], 0.0)
                score[:, i] += -np.logaddexp(0, -d / max(float(d.std()), 1e-6)) / max(1, k - 1)
    return np.where(values > 0, log_softmax(score), -np.inf)


def blend(a: np.ndarray, b: np.ndarray, w) -> np.ndarray:
    """(1 - w) a + w b; where one is not finite, the other."""
    w = np.reshape(w, (-1, 1)) if np.ndim(w) else w
    both = np.isfinite(a) & np.isfinite(b)
    with np.errstate(invalid="ignore"):
        return np.where(both, (1 - w) * a + w * b, np.where(np.isfinite(a), a, b))


def positive_median(x: np.ndarray) -> float:
    """The positive values' element at n div 2; 1 without any."""
    p = np.sort(x[x > 0])
    return float(p[len(p) // 2]) if len(p) else 1.0


def last_argmax(e: np.ndarray) -> np.ndarray:
    return e.shape[1] - 1 - e[:, ::-1].argmax(1)


def blend_per_population(a, b, weight: float, agree: np.ndarray, disagree: np.ndarray, hybrid: bool = False, low: float = 0.2, high: float = 3.0) -> np.ndarray:
    """Agreement blend whose scale is looked up by the best population where both models
    agree, and by the pair of best ones where they differ."""
    i, j = last_argmax(a), last_argmax(b)
    g = gap(b)
    scale = np.clip(g / positive_median(g), low, high) if hybrid else 1.0
    w = np.where(i == j, weight * agree[i] * scale, weight * disagree[i, j])
    return blend(a, b, np.clip(w, 0, 0.95))


def identity_floor(best: np.ndarray) -> float:
    """Where the windows' highest similarities have their largest gap below the first
    quartile, if it stands out of the spread; never under .9; .995 for under 20 windows."""
    x = np.sort(np.asarray(best, float))
    if len(x) < 20:
        return 0.995
    q1, q3 = np.percentile(x, [25, 75])
    low = x[x <= q1]
    d = np.diff(low)
    cut = low[d.argmax() + 1] if len(d) and d.max() > 1.5 * (q3 - q1) else q1 - 1.5 * (q3 - q1)
    return float(max(cut, 0.9)) if x[-1] > 0 else 0.9


def ensemble(values: np.ndarray, temperature: float, switch: float, size: int, scale: float = 2.0) -> np.ndarray:
    """Mean posteriors of decodings with temperature and switch rate spread over a factor."""
    n, k = values.shape
    if size < 1:
        return np.empty((0, k))
    total = np.zeros((n, k))
    for f in np.exp(np.linspace(-1, 1, size) * math.log(scale)) if size > 1 else [1.0]:
        s = min(switch * f, 0.5)
        t = np.full((1, k, k), math.log(s / max(1, k - 1)))
        t[:, np.arange(k), np.arange(k)] = math.log1p(-s)
        e = softmax_emissions(values, temperature * f)
        total += chain.posteriors(np.where(np.isfinite(e), e, -1e3)[None], np.full((1, k), -math.log(k)), t, np.array([n]))[0][0]
    return total / size


def copying(sims: np.ndarray, groups: np.ndarray, k: int, switch: float, fraction: float, temperature: float, default: float) -> tuple[np.ndarray, np.ndarray]:
    """A mosaic of haplotypes: a switch stays within the population but for a fraction of
    them. Population states and posteriors."""
    n, h = sims.shape
    e = np.where(sims > 0, sims, default) / temperature
    e = log_softmax(e)[None]
    size = np.bincount(groups, minlength=k)
    same = groups[:, None] == groups[None]
    away = max(1, k - 1)
    t = np.where(same, switch * (1 - fraction) / size[groups][None], switch * fraction / away / size[groups][None])
    t = t + (1 - switch) * np.eye(h)
    t = np.log(t / t.sum(1, keepdims=True))[None]
    init, lengths = np.full((1, h), -math.log(h)), np.array([n])
    path = groups[chain.viterbi(e, init, t, lengths)[0]]
    post = chain.posteriors(e, init, t, lengths)[0][0]
    return path, np.stack([post[:, groups == p].sum(1) for p in range(k)], 1)
