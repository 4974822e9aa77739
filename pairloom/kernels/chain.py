"""Hidden Markov recursions over many sequences at once.

Sequences are stacked as [sequences, windows, states] and padded; lengths say how many
windows count. Transitions are log matrices [sequences, states, states], or
[sequences, windows - 1, states, states] for a matrix of its own for each step."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis=axis))


def _step(trans: np.ndarray, t: int) -> np.ndarray:
    return trans if trans.ndim == 3 else trans[:, t]


def forward(emit: np.ndarray, init: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log alphas, and each sequence's log likelihood."""
    g, n, k = emit.shape
    alpha = np.empty_like(emit)
    alpha[:, 0] = init + emit[:, 0]
    for t in range(1, n):
        alpha[:, t] = _lse(alpha[:, t - 1, :, None] + _step(trans, t - 1), 1) + emit[:, t]
    return alpha, _lse(alpha[np.arange(g), lengths - 1], 1)


def backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    g, n, k = emit.shape
    beta = np.zeros_like(emit)
    for t in range(n - 2, -1, -1):
        inner = _lse(_step(trans, t) + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t < lengths - 1)[:, None], inner, 0.0)
    return beta


def posteriors(emit, init, trans, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every state in every window, and log likelihoods."""
    alpha, ll = forward(emit, init, trans, lengths)
    log = alpha + backward(emit, trans, lengths)
    log -= _lse(log, 2)[:, :, None]
    return np.exp(log), ll


def viterbi(emit, init, trans, lengths) -> np.ndarray:
    """Most likely paths. Of equal predecessors, and of equal last states, the first wins."""
    g, n, k = emit.shape
    score, back = init + emit[:, 0], np.zeros((g, n, k), np.int8)
    last = np.where((lengths == 1)[:, None], score, -np.inf)
    for t in range(1, n):
        step = score[:, :, None] + _step(trans, t - 1)
        back[:, t] = step.argmax(1)
        score = step.max(1) + emit[:, t]
        last = np.where((lengths == t + 1)[:, None], score, last)
    path = np.zeros((g, n), np.int64)
    at = np.arange(g)
    state = last.argmax(1)
    for t in range(n - 1, -1, -1):
        state = np.where(t == lengths - 1, last.argmax(1), state)
        path[:, t] = state
        if t:
            state = np.where(t <= lengths - 1, back[at, t, state], state)
    return path


def stack(sequences: list[np.ndarray], fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of unequal length as one padded array, and their lengths."""
    lengths = np.array([len(s) for s in sequences])
    out = np.full((len(sequences), int(lengths.max()), *sequences[0].shape[1:]), fill)
    for k, s in enumerate(sequences):
        out[k, : len(s)] = s
    return out, lengths
