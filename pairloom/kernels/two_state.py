"""The two-state model of shared and unshared windows: parameters, training, decoding."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from pairloom.kernels import chain
from pairloom.kernels.gauss import Gauss, information, kmeans, mixture

# Fixed values of the model.
DIVERSITY = {"AFR": 0.00125, "EUR": 0.00085, "EAS": 0.00080, "CSA": 0.00095, "AMR": 0.00100, "INTERPOP": 0.00110, "GENERIC": 0.00100}
ALIASES = {"INTER": "INTERPOP", "UNKNOWN": "GENERIC"}
ADAPTIVE = {"AFR": (0.7, 0.3), "EAS": (1.1, 1.0), "CSA": (0.9, 0.8), "AMR": (0.8, 0.7), "INTERPOP": (0.5, 0.1)}
EM_START = {"AFR": (0.98, 15.0), "INTERPOP": (0.99, 10.0)}
SHARED = Gauss(0.9997, 0.0005)


def population(name: str) -> str:
    key = ALIASES.get(name.upper(), name.upper())
    if key not in DIVERSITY:
        raise ValueError(f"unknown population {name}")
    return key


def background(pop: str, window: int) -> Gauss:
    pi = DIVERSITY[pop]
    return Gauss(1 - pi, math.sqrt(3 * pi / max(1, window)))


Bounds = tuple[float, float]


def logit(x):
    y = np.clip(np.asarray(x, float), 1e-10, 1 - 1e-10)
    return np.clip(np.log(y / (1 - y)), -12.0, 12.0)


def to_logit(g: Gauss) -> Gauss:
    """The Gaussian of the logit by the delta method, its deviation within .01 and 6."""
    spread = g.mean * (1 - g.mean)
    return Gauss(float(logit(g.mean)), max(min(g.std / spread, 6.0) if spread > 1e-15 else 6.0, 0.01))


@dataclass(frozen=True)
class Space:
    """Scale of the observations: priors of both states, and the bounds of estimates."""

    low: Gauss
    high: Gauss
    separation: float
    still: tuple[float, float, float, float]  # variance that is none, mean from which it is high, least deviations
    first: tuple[Bounds, Bounds, Bounds, Bounds]  # low mean, low deviation, high mean, high deviation
    trained: tuple[Bounds, Bounds, Bounds, Bounds]

    @classmethod
    def of(cls, pop: str, window: int, in_logits: bool = False) -> Space:
        low = background(pop, window)
        if not in_logits:
            mean = (low.mean - 0.005, 0.9993)
            return cls(low, SHARED, 5e-4, (1e-8, 0.9993, 0.001, 0.0005), (mean, (0.0005, 0.005), (0.999, 1.0), (0.0003, 0.002)), (mean, (0.0003, 0.005), (0.999, 1.0), (0.0002, 0.002)))
        low, high, any_mean = to_logit(low), to_logit(SHARED), (-math.inf, math.inf)
        return cls(low, high, 0.5, (1e-6, high.mean - 1, 0.2, 0.1), (any_mean, (0.1, 5.0), any_mean, (0.05, 3.0)), ((low.mean - 2, low.mean + 2), (0.2, 3.0), (high.mean - 1, 12.0), (0.2, 3.0)))


@dataclass(frozen=True)
class Params:
    """Entering and leaving probabilities, and the emissions of both states."""

    enter: float
    leave: float
    low: Gauss
    high: Gauss
    start: float

    @classmethod
    def of(cls, pop: str = "GENERIC", expected_windows: float = 50, enter: float = 1e-4, window: int = 10_000, adaptive: bool = False, in_logits: bool = False) -> Params:
        pop = population(pop)
        if adaptive:
            length, rate = ADAPTIVE.get(pop, (1.0, 1.0))
            expected_windows, enter = max(expected_windows * length, 2.0), min(max(enter * rate, 1e-8), 0.999)
        stay = min(max(1 - 1 / expected_windows, 0.5), 0.9999)
        space = Space.of(pop, window, in_logits)
        return cls(enter, 1 - stay, space.low, space.high, enter)

    def log_start(self) -> np.ndarray:
        return np.log([1 - self.start, self.start])

    def log_trans(self) -> np.ndarray:
        return np.log([[1 - self.enter, self.enter], [self.leave, 1 - self.leave]])

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.low.log_pdf(x), self.high.log_pdf(x)], -1)


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def bounded(mean: float, std: float, means: Bounds, stds: Bounds) -> Gauss:
    return Gauss(clamp(mean, *means), clamp(std, *stds))


def robust(p: Params, x: np.ndarray, pop: str, window: int, in_logits: bool = False) -> Params:
    """Emissions from the data: k-means where two clusters stand apart, else a mixture drawn
    to the prior if it explains the data better than one Gaussian; all within bounds."""
    x = np.asarray(x, float)
    if len(x) < 10:
        return p
    space, mean, var = Space.of(pop, window, in_logits), float(x.mean()), float(x.var())
    none, from_high, least_low, least_high = space.still
    if var < none:
        if mean > from_high:
            return replace(p, high=Gauss(mean, max(math.sqrt(var), least_high)))
        return replace(p, low=Gauss(mean, max(math.sqrt(var), least_low)))
    low_of = lambda m, s: bounded(m, s, *space.first[:2])
    high_of = lambda m, s: bounded(m, s, *space.first[2:])
    centres, label = kmeans(x, 2, 30)
    if abs(centres[0] - centres[1]) > space.separation:
        first = int(centres[0] >= centres[1])
        a, b = x[label == first], x[label != first]
        if len(a) > 2:
            p = replace(p, low=low_of(float(a.mean()), float(a.std())))
        if len(b) > 2:
            p = replace(p, high=high_of(float(b.mean()), float(b.std())))
        return p
    weight, strength = EM_START.get(pop, (0.95, 5.0))
    found = mixture(x, space.low, space.high, weight, strength=strength) or mixture(x, space.low, space.high, weight)
    if found and abs(found[1].mean - found[0].mean) > space.separation / 2:
        one, two = information(x, *found)
        if two < one:
            return replace(p, low=low_of(found[0].mean, found[0].std), high=high_of(found[1].mean, found[1].std))
    return p


def train(params: list[Params], xs: list[np.ndarray], pop: str, window: int, rounds: int, tol: float = 1e-6, in_logits: bool = False, extra: list[np.ndarray] | None = None, step_of: Callable[[int, Params], np.ndarray] | None = None) -> list[Params]:
    """Baum-Welch of means, deviations and transitions, each sequence with its own
    parameters, all sequences in one sweep. Bounds keep the states apart; where they
    would cross, both emissions start anew. Sequences of under 10 windows stay. extra
    adds fixed log emissions of other observations; step_of gives a sequence's log matrix
    for each step, scaled from its parameters, which stay those of one window."""
    params = list(params)
    live = [k for k, x in enumerate(xs) if len(x) >= 10]
    last = dict.fromkeys(live, -math.inf)
    space = Space.of(pop, window, in_logits)
    for _ in range(rounds):
        if not live:
            break
        obs, lengths = chain.stack([np.asarray(xs[k], float) for k in live])
        emit, _ = chain.stack([params[k].emissions(xs[k]) + (extra[k] if extra else 0.0) for k in live])
        start = np.stack([params[k].log_start() for k in live])
        trans = chain.stack([step_of(k, params[k]) for k in live])[0] if step_of else np.stack([params[k].log_trans() for k in live])
        alpha, ll = chain.forward(emit, start, trans, lengths)
        beta = chain.backward(emit, trans, lengths)
        moving = [i for i, k in enumerate(live) if not abs(ll[i] - last[k]) < tol]
        for i in moving:
            last[live[i]] = ll[i]
        if not moving:
            break
        valid = np.arange(obs.shape[1]) < lengths[:, None]
        joint = alpha + beta
        gamma = np.exp(joint - np.logaddexp(joint[..., 0], joint[..., 1])[..., None]) * valid[..., None]
        xi = alpha[:, :-1, :, None] + (trans if step_of else trans[:, None]) + (emit + beta)[:, 1:, None, :]
        xi = np.exp(xi - xi.max(axis=(2, 3), keepdims=True))
        xi = (xi / xi.sum(axis=(2, 3), keepdims=True) * valid[:, 1:, None, None]).sum(1)
        size = gamma.sum(1)
        scale = np.where(size > 1, size, 1.0)
        mu = (gamma * obs[..., None]).sum(1) / scale
        sd = np.sqrt((gamma * (obs[..., None] - mu[:, None]) ** 2).sum(1) / scale)
        for i in moving:
            k, p = live[i], params[live[i]]
            low = bounded(float(mu[i, 0]), float(sd[i, 0]), *space.trained[:2])
            high = bounded(float(mu[i, 1]), float(sd[i, 1]), *space.trained[2:])
            if low.mean >= high.mean:
                low, high = space.low, space.high
            row = xi[i].sum(1)
            enter = xi[i, 0, 1] / row[0] if row[0] > 1 else p.enter
            leave = xi[i, 1, 0] / row[1] if row[1] > 1 else p.leave
            params[k] = replace(p, low=low, high=high, enter=clamp(float(enter), 1e-8, 0.1), leave=clamp(float(leave), 0.001, 0.5))
        live = [live[i] for i in moving]
    return params


def side_emissions(value: np.ndarray, post: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """Log densities of a second observation under Gaussians that the posteriors weight."""
    out = np.zeros((len(value), 2))
    for k, w in enumerate((1 - post, post)):
        total = float(w.sum())
        if total > 1.0:
            m = float((w * value).sum()) / total
            out[:, k] = Gauss(m, max(math.sqrt(max(float((w * (value - m) ** 2).sum()) / total, 0.0)), least)).log_pdf(value)
        else:
            return np.zeros((len(value), 2))
    return out


def distance_transitions(p: Params, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A log matrix for each step: rates -ln(1 - p) times the distance of the windows'
    midpoints over the first window's length."""
    middle = (starts + ends) // 2
    window = int(ends[0] - starts[0] + 1)
    ratio = np.diff(middle) / window if window > 0 else np.zeros(len(middle) - 1)
    prob = lambda q: np.where(ratio > 0, np.clip(-np.expm1(np.log1p(-q) * ratio), 1e-10, 1 - 1e-10), q)
    enter, leave = prob(p.enter), prob(p.leave)
    return np.log(np.stack([np.stack([1 - enter, enter], -1), np.stack([leave, 1 - leave], -1)], -2))


def map_transitions(p: Params, middle: np.ndarray, cm: np.ndarray, cm_next: np.ndarray, window: int) -> np.ndarray:
    """A log matrix for each step by the genetic map: rates -ln(1 - p) times the step's map
    distance over that of one window at its start (one centimorgan a megabase where the map
    has none); leaving also by one plus Haldane's recombination fraction. Chromosomes
    without a map, steps without distance and windows of size 0 take p as it is."""
    d = np.abs(np.diff(cm))
    nominal = np.abs(cm_next - cm)[:-1]
    scale = d / np.where(nominal > 0, nominal, max(window, 1) / 1e6)
    more = 1 + 0.5 * -np.expm1(-d / 50)
    plain = (np.diff(middle) == 0) | (window == 0) | ~np.isfinite(scale)
    prob = lambda q, x: np.where(plain, q, np.clip(-np.expm1(np.log1p(-q) * np.where(plain, 1.0, x)), 1e-10, 1 - 1e-10))
    enter, leave = prob(p.enter, scale), prob(p.leave, scale * more)
    return np.log(np.stack([np.stack([1 - enter, enter], -1), np.stack([leave, 1 - leave], -1)], -2))


def simple(p: Params, x: np.ndarray) -> Params:
    """Emissions from two clusters as they are, with deviations of at least .01 and .001; where
    there are not two, from the places at .3 and .9 of the order, with .05 and .01. Fewer
    than three values, or no variance, change nothing."""
    x = np.asarray(x, float)
    if len(x) < 3 or x.var() < 1e-12:
        return p
    if (found := kmeans(x, 2, 20)) is None:
        s, std = np.sort(x), float(x.std())
        return replace(p, low=Gauss(float(s[int(len(s) * 0.3)]), max(std, 0.05)), high=Gauss(float(s[min(int(len(s) * 0.9), len(s) - 1)]), max(std, 0.01)))
    centres, label = found
    first = int(centres[0] >= centres[1])
    a, b = x[label == first], x[label != first]
    if len(a):
        p = replace(p, low=Gauss(float(a.mean()), max(float(a.std()), 0.01)))
    return replace(p, high=Gauss(float(b.mean()), max(float(b.std()), 0.001))) if len(b) else p


def decode(params: list[Params], emits: list[np.ndarray], steps: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(states, posteriors of sharing) of every sequence."""
    emit, lengths = chain.stack(emits)
    start = np.stack([p.log_start() for p in params])
    trans = chain.stack(steps)[0] if steps else np.stack([p.log_trans() for p in params])
    path = chain.viterbi(emit, start, trans, lengths)
    post, _ = chain.posteriors(emit, start, trans, lengths)
    return [(path[k, :n].copy(), post[k, :n, 1].copy()) for k, n in enumerate(lengths)]


def smooth_rows(x: np.ndarray, context: int) -> np.ndarray:
    """Mean of each row with up to `context` rows on either side."""
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
    a = np.maximum(np.arange(len(x)) - context, 0)
    b = np.minimum(np.arange(len(x)) + context + 1, len(x))
    return (sums[b] - sums[a]) / (b - a)[:, None]


def run_list(states: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of 1."""
    edge = np.flatnonzero(np.diff(np.r_[0, (states == 1).astype(int), 0]))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def refine(states: np.ndarray, post: np.ndarray, extend: float = 0.5, trim: float = 0.2) -> np.ndarray:
    """Runs grow over neighbours at `extend` or above as far as they reach; then, from left
    to right, windows below `trim` at a run's edge leave it."""
    s = states.copy()
    near = (s == 1) | (post >= extend)
    for a, b in run_list(near.astype(int)):
        if s[a : b + 1].any():
            s[a : b + 1] = 1
    padded = np.r_[0, s, 0]
    for i in range(1, len(s) + 1):
        if padded[i] and post[i - 1] < trim and not (padded[i - 1] and padded[i + 1]):
            padded[i] = 0
    return padded[1:-1]


def refine_adaptive(states: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Each run with thresholds by its mean posterior: confident ones extend further."""
    s, n = states.copy(), len(states)
    for a, b in run_list(states):
        m = float(post[a : b + 1].mean())
        extend, trim = (0.3, 0.3) if m > 0.8 else (0.4 + (0.8 - m) * 0.67, 0.15 + (m - 0.5) * 0.5) if m > 0.5 else (0.6, 0.15)
        while a > 0 and s[a - 1] == 0 and post[a - 1] >= extend:
            a -= 1
            s[a] = 1
        while b + 1 < n and s[b + 1] == 0 and post[b + 1] >= extend:
            b += 1
            s[b] = 1
        inside = np.flatnonzero(post[a : b + 1] >= trim)
        first, last = (a + int(inside[0]), a + int(inside[-1])) if len(inside) else (b + 1, b)
        s[a:first] = 0
        s[last + 1 : b + 1] = 0
    return s


def bridge(states: np.ndarray, post: np.ndarray, max_gap: int, least: float, adaptive: bool = False) -> np.ndarray:
    """Fills gaps of at most max_gap windows between runs whose mean posterior reaches
    `least`. Adaptive: confident flanks ask for less, and a bridged run is looked at
    again as a whole."""
    s, k = states.copy(), 0
    runs = run_list(s)
    while k + 1 < len(runs):
        (a, b), (c, d) = runs[k], runs[k + 1]
        bound = least
        if adaptive:
            q = (post[a : b + 1].mean() + post[c : d + 1].mean()) / 2
            bound = least * (0.5 if q > 0.8 else 1 - (q - 0.5) / 0.6 if q > 0.5 else 1.0)
        if c - b - 1 <= max_gap and post[b + 1 : c].mean() >= bound:
            s[b + 1 : c] = 1
            runs[k : k + 2] = [(a, d)] if adaptive else [runs[k + 1]]
        else:
            k += 1
    return s


def multi_scale(params: Params, x: np.ndarray, states: np.ndarray, post: np.ndarray, scales=(2, 4)) -> np.ndarray:
    """Ranges that only a coarser decoding sees are added where the mean posterior is over
    .3; runs that no coarser decoding confirms go if their mean is below .7."""
    if len(x) < 6:
        return states
    coarse = []
    for f in scales:
        blocks = np.array([x[i : i + f].mean() for i in range(0, len(x), f)])
        if len(blocks) >= 3:
            path, _ = decode([params], [params.emissions(blocks)])[0]
            coarse += [(a * f, min((b + 1) * f, len(x)) - 1) for a, b in run_list(path)]
    base, out = run_list(states), states.copy()
    for a, b in coarse:
        if not any(c <= b and a <= d for c, d in base) and post[a : b + 1].mean() > 0.3:
            out[a : b + 1][post[a : b + 1] > 0.3] = 1
    for a, b in base:
        if not any(a <= d and c <= b for c, d in coarse) and post[a : b + 1].mean() < 0.7:
            out[a : b + 1] = 0
    return out


def shared_rates(indicator: np.ndarray, post: np.ndarray) -> tuple[float, float]:
    """Rate of an indicator in the unshared and the shared state, within .001 and .999."""
    w1, w0 = float(post.sum()), float((1 - post).sum())
    rate = lambda w, total, prior: clamp(float((w * indicator).sum()) / total, 0.001, 0.999) if total > 1e-10 else prior
    return rate(1 - post, w0, 0.015), rate(post, w1, 0.22)
