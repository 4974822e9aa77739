"""Transition matrices of second passes: [steps, states, states], logs, rows summing to 1.

All are inferred from one sentence each; no parity is claimed. base: a log matrix;
post and states: the first pass's posteriors and path; e: log emissions."""

from __future__ import annotations

import numpy as np

from pairloom.kernels.estimates import train_transitions
from pairloom.kernels.transforms import frames


def normal(t: np.ndarray) -> np.ndarray:
    top = t.max(-1, keepdims=True)
    return t - top - np.log(np.exp(t - top).sum(-1, keepdims=True))


def repeated(base: np.ndarray, steps: int) -> np.ndarray:
    return np.broadcast_to(base, (steps, *base.shape)).copy()


def stay_bonus(base: np.ndarray, bonus: np.ndarray) -> np.ndarray:
    """A bonus on staying for each step (and state)."""
    out, k = repeated(base, len(bonus)), len(base)
    out[:, np.arange(k), np.arange(k)] += np.reshape(bonus, (len(bonus), -1))
    return normal(out)


def entropy(post: np.ndarray) -> np.ndarray:
    return -(post * np.log(np.maximum(post, 1e-12))).sum(1) / np.log(max(2, post.shape[1]))


def adaptive(base, post, scale: float = 1.0):
    """Switching costs more where the posteriors are sure on both sides."""
    h = entropy(post)
    return stay_bonus(base, scale * (1 - np.maximum(h[1:], h[:-1])))


def boundary_boost(base, states, boost: float = 1.0):
    """Switching is easier where the first pass switches."""
    return stay_bonus(base, np.where(states[1:] != states[:-1], -boost, 0.0))


def cooccurrence(base, states, bonus: float = 0.5):
    """A bonus for pairs of states that the first pass often has side by side."""
    k = len(base)
    n = np.zeros((k, k))
    np.add.at(n, (states[:-1], states[1:]), states[:-1] != states[1:])
    return normal(repeated(base + bonus * n / max(1.0, n.max()), len(states) - 1))


def confusion_penalties(states, k: int, penalty: float = 0.5) -> np.ndarray:
    """A penalty for each pair by its share of the first pass's switches."""
    n = np.zeros((k, k))
    np.add.at(n, (states[:-1], states[1:]), states[:-1] != states[1:])
    n = n + n.T
    return penalty * n / max(1.0, n.sum() / 2)


def confusion(base, states, penalty: float = 0.5):
    return normal(repeated(base - confusion_penalties(states, len(base), penalty), len(states) - 1))


def run_lengths(states: np.ndarray) -> np.ndarray:
    """How long the run at each window already is."""
    start = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
    return np.arange(len(states)) - np.repeat(start, np.diff(np.r_[start, len(states)])) + 1


def momentum(base, states, rate: float = 0.1, most: float = 2.0):
    """Staying pays more the longer the first pass's run is."""
    return stay_bonus(base, np.minimum(rate * np.log(run_lengths(states)[:-1]), most))


def segment_length(base, states, least: int = 5, weight: float = 1.0):
    """Leaving a run before `least` windows costs more."""
    return stay_bonus(base, weight * np.maximum(0, 1 - run_lengths(states)[:-1] / least))


def lookahead(base, e, radius: int = 3, weight: float = 0.5):
    """Moves to a state gain by its mean evidence in the next windows."""
    x = np.where(np.isfinite(e), e, -50.0)
    ahead = np.stack([x[t + 1 : t + 1 + radius].mean(0) for t in range(len(x) - 1)])
    return normal(repeated(base, len(ahead)) + weight * (ahead - ahead.max(1, keepdims=True))[:, None, :])


def recency(base, post, decay: float = 0.8, weight: float = 0.5):
    """Moves to a state gain by its exponentially fading history."""
    h, out = post[0].copy(), []
    for p in post[:-1]:
        h = decay * h + (1 - decay) * p
        out.append(np.log(np.maximum(h, 1e-6)))
    return normal(repeated(base, len(out)) + weight * np.array(out)[:, None, :])


def disagreement(base, e, states, bonus: float = 0.5):
    """Staying pays where the emissions' best state is the first pass's."""
    return stay_bonus(base, np.where(e.argmax(1) == states, bonus, 0.0)[1:])


def population_aware(means: np.ndarray, stay: float, scale: float) -> np.ndarray:
    """Switches in proportion to exp(-distance / scale) of the populations' profiles."""
    d = np.exp(-np.abs(np.subtract.outer(means, means)) / scale)
    np.fill_diagonal(d, 0.0)
    out = (1 - stay) * d / d.sum(1, keepdims=True)
    np.fill_diagonal(out, stay)
    return np.log(out)


def purity(sims: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Per reference haplotype: how often its own population leads in the windows where the
    haplotype is the best one."""
    best = sims.argmax(1)
    lead = np.stack([np.where(groups == p, sims, 0).mean(1) * len(groups) / max(1, (groups == p).sum()) for p in range(k)], 1).argmax(1)
    n = np.bincount(best, minlength=sims.shape[1])
    hit = np.bincount(best, lead == groups[best], minlength=sims.shape[1])
    return np.where(n > 0, hit / np.maximum(n, 1), 1.0)


def purity_weighted(sims, weights, gamma: float = 1.0):
    return sims * np.maximum(weights, 1e-3) ** gamma


def calibration_boosts(states: np.ndarray, expected: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """A boost for states that the first pass has less of than expected."""
    seen = np.bincount(states, minlength=len(expected)) / max(1, len(states))
    return scale * np.log(np.maximum(expected, 1e-6) / np.maximum(seen, 1e-6)).clip(-1, 1)


def window_quality(e: np.ndarray, states: np.ndarray, spread: np.ndarray, radius: int = 2) -> np.ndarray:
    """margin x discriminability x agreement of the neighbours, each within 0 and 1."""
    s = np.sort(np.where(np.isfinite(e), e, -50.0), 1)
    margin = 1 - np.exp(-(s[:, -1] - s[:, -2])) if e.shape[1] > 1 else np.ones(len(e))
    agree = np.array([(states[f] == states[t]).mean() for t, f in enumerate(frames(len(e), radius))])
    return margin * np.clip(spread / max(float(np.max(spread)), 1e-12), 0, 1) * agree


def expected_moves(post: np.ndarray) -> np.ndarray:
    """Moves between states under independent neighbouring posteriors."""
    return post[:-1].T @ post[1:]


def retrained(base: np.ndarray, post: np.ndarray, dampening: float = 0.0) -> np.ndarray:
    return np.log(np.maximum(train_transitions(post, expected_moves(post), np.exp(base), dampening), 1e-300))
