"""Left-to-right post-processing of state sequences and greedy matching of switches."""

from __future__ import annotations

import numpy as np


def _ends(s: np.ndarray, i: int) -> int:
    j = i + 1
    while j < len(s) and s[j] == s[i]:
        j += 1
    return j


def smooth(states, min_run: int, posteriors=None, least: float = 0.0) -> np.ndarray:
    """Runs shorter than min_run between equal states take that state, from left to right;
    with posteriors, only if it has `least` somewhere in the run."""
    s = np.array(states, int)
    if len(s) < 3 and posteriors is None or min_run < 2:
        return s
    i = 0
    while i < len(s):
        j = _ends(s, i)
        if j - i < min_run and 0 < i and j < len(s) and s[i - 1] == s[j] and (posteriors is None or (posteriors[i:j, s[j]] >= least).any()):
            s[i:j] = s[j]
        i = j
    return s


def posterior_smooth(states, posteriors, min_run: int, confident: float = 0.6, least: float = 0.1) -> np.ndarray:
    """Evidence-gated smoothing; then unsure windows join a neighbour of their best state;
    then plain smoothing."""
    p = np.asarray(posteriors, float)
    if not len(p) or len(p) != len(states) or min_run < 2:
        return np.array(states, int)
    s = smooth(states, min_run, p, least)
    best = p.shape[1] - 1 - p[:, ::-1].argmax(1)
    for i in range(len(s)):
        if p[i, s[i]] < confident and best[i] != s[i] and (i and s[i - 1] == best[i] or i + 1 < len(s) and s[i + 1] == best[i]):
            s[i] = best[i]
    return smooth(s, min_run)


def match_switches(ours, truth, tolerance: float) -> dict:
    """In order of truth, each switch takes the nearest one of ours still free and within
    the tolerance: matched, missed, spurious, precision, recall, mean distance."""
    free, distances = sorted(ours), []
    for t in truth:
        if free:
            k = min(range(len(free)), key=lambda i: abs(free[i] - t))
            if abs(free[k] - t) <= tolerance:
                distances.append(abs(free.pop(k) - t))
    hit = len(distances)
    return {"matched": hit, "missed": len(truth) - hit, "spurious": len(free), "precision": hit / len(ours) if len(ours) else 0.0, "recall": hit / len(truth) if len(truth) else 1.0, "mean_distance": float(np.mean(distances)) if distances else 0.0}


def correct_short(states, posteriors, min_run: int) -> np.ndarray:
    """Runs shorter than min_run join the neighbouring run whose state has the higher mean
    posterior over them, from left to right. (Known from one sentence; inferred.)"""
    s, p = np.array(states, int), np.asarray(posteriors, float)
    i = 0
    while i < len(s):
        j = _ends(s, i)
        sides = ([s[i - 1]] if i else []) + ([s[j]] if j < len(s) else [])
        if j - i < min_run and sides:
            s[i:j] = max(sides, key=lambda q: p[i:j, q].mean())
        i = j
    return s
