"""Gaussian estimators in one dimension: k-means, mixtures, information criterion."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

LOG_2PI = math.log(2 * math.pi)


@dataclass(frozen=True)
class Gauss:
    mean: float
    std: float

    def __post_init__(self):
        if not (math.isfinite(self.mean) and math.isfinite(self.std) and self.std > 0):
            raise ValueError(f"not a Gaussian: mean {self.mean}, deviation {self.std}")

    def log_pdf(self, x):
        z = (np.asarray(x, float) - self.mean) / self.std
        return -0.5 * z * z - math.log(self.std) - 0.5 * LOG_2PI


def kmeans(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres and assignments, from quantile seeds; ties go to the lower centre. The
    assignments are those the last centres were computed from."""
    x = np.asarray(x, float)
    n = len(x)
    if k == 0 or n < k:
        return None
    ordered = np.sort(x)
    centres = ordered[np.minimum((((np.arange(k) + 0.5) / k) * n).astype(int), n - 1)]
    label = np.zeros(n, int)
    for _ in range(rounds):
        new = np.abs(x[:, None] - centres).argmin(1)
        if (new == label).all():
            break
        label = new
        count = np.bincount(label, minlength=k)
        sums = np.bincount(label, x, minlength=k)
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres, label


def mixture(x: np.ndarray, low: Gauss, high: Gauss, weight_low: float, rounds: int = 100, tol: float = 1e-6, strength: float = 0.0) -> tuple[Gauss, Gauss, float] | None:
    """EM of two Gaussians; with a strength, means and variances are drawn to the first
    ones with that many pseudo-observations. None when a component vanishes."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4:
        return None
    prior = np.array([[low.mean, low.std], [high.mean, high.std]])
    mu, sd, w = prior[:, 0].copy(), prior[:, 1].copy(), np.array([weight_low, 1 - weight_low])
    least, last = (0.5 if strength else 1.0), -math.inf
    for _ in range(rounds):
        z = (x[:, None] - mu) / sd
        joint = np.log(w) - 0.5 * z * z - np.log(sd) - 0.5 * LOG_2PI
        norm = np.logaddexp(joint[:, 0], joint[:, 1])
        total = float(norm.sum())
        if abs(total - last) < tol:
            break
        last = total
        r = np.exp(joint[:, 0] - norm)
        resp = np.stack([r, 1 - r])
        size = resp.sum(1)
        if (size < least).any():
            return None
        w = size / n
        mu = (resp @ x + strength * prior[:, 0]) / (size + strength)
        var = (resp * (x - mu[:, None]) ** 2).sum(1)
        sd = np.maximum(np.sqrt((var + strength * prior[:, 1] ** 2) / (size + strength)), 1e-6)
    order = np.argsort(mu, kind="stable")
    return Gauss(*map(float, (mu[order[0]], sd[order[0]]))), Gauss(*map(float, (mu[order[1]], sd[order[1]]))), float(w[order[0]])


def information(x: np.ndarray, low: Gauss, high: Gauss, weight_low: float) -> tuple[float, float]:
    """BIC of one Gaussian (2 parameters) and of the two (5)."""
    x = np.asarray(x, float)
    one = Gauss(float(x.mean()), max(float(x.std()), 1e-10)).log_pdf(x).sum()
    w = min(max(weight_low, 1e-300), 1 - 1e-16)
    two = np.logaddexp(math.log(w) + low.log_pdf(x), math.log1p(-w) + high.log_pdf(x)).sum()
    return -2 * float(one) + 2 * math.log(len(x)), -2 * float(two) + 5 * math.log(len(x))
