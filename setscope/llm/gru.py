"""A small bidirectional GRU with attention pooling, forward and backward, in numpy.

Gates per direction lie side by side as update, reset, candidate. Positions
beyond a window's length leave the state as it is and get no attention.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 8
ATTENTION = 8
DIRECTIONS = ("f", "b")


def initial(inputs: int, seed: int = 0) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    h = HIDDEN
    params = {"w": rnd.normal(0, 0.3, (inputs, 6 * h)), "c": np.zeros(6 * h),
              "a": rnd.normal(0, 0.3, (2 * h, ATTENTION)), "v": rnd.normal(0, 0.3, ATTENTION),
              "o": rnd.normal(0, 0.3, 2 * h), "d": np.zeros(1)}
    params |= {f"u{d}": rnd.normal(0, 0.3, (h, 3 * h)) for d in DIRECTIONS}
    return params


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _steps(n: int, direction: str) -> range:
    return range(n) if direction == "f" else range(n - 1, -1, -1)


def forward(params: dict, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows: ``projected`` is (positions, windows, 6 hidden), ``mask`` (positions, windows).

    With ``keep`` also what the backward pass needs.
    """
    n, windows, _ = projected.shape
    h = HIDDEN
    states = np.empty((n, windows, 2 * h), dtype=projected.dtype)
    full = bool(mask.all())
    tape = {}
    for k, d in enumerate(DIRECTIONS):
        state = np.zeros((windows, h), dtype=projected.dtype)
        u = params["u" + d]
        for t in _steps(n, d):
            x = projected[t, :, 3 * h * k:3 * h * (k + 1)]
            r = state @ u
            gates = _sigmoid(x[:, :2 * h] + r[:, :2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            candidate = np.tanh(x[:, 2 * h:] + reset * r[:, 2 * h:])
            new = candidate + update * (state - candidate)
            if not full:
                new = np.where(mask[t][:, None], new, state)
            if keep:
                tape[d, t] = state, update, reset, candidate, r[:, 2 * h:]
            state = new
            states[t, :, h * k:h * (k + 1)] = state
    hidden = np.tanh(states.reshape(-1, 2 * h) @ params["a"]).reshape(n, windows, -1)
    score = hidden @ params["v"]
    if not full:
        score = np.where(mask, score, -1e9)
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tw,twh->wh", weight, states)
    logits = pooled @ params["o"] + params["d"][0]
    return (logits, (states, hidden, weight, pooled, tape)) if keep else logits


def backward(params: dict, kept, mask: np.ndarray, d_logits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of ``projected``."""
    states, hidden, weight, pooled, tape = kept
    n, windows, _ = states.shape
    h = HIDDEN
    grads = {"o": pooled.T @ d_logits, "d": np.array([d_logits.sum()])}
    d_pooled = d_logits[:, None] * params["o"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("twh,wh->tw", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["v"] = np.einsum("tw,twa->a", d_score, hidden)
    d_hidden = d_score[:, :, None] * params["v"] * (1 - hidden**2)
    grads["a"] = np.einsum("twh,twa->ha", states, d_hidden)
    d_states += d_hidden @ params["a"].T
    d_projected = np.zeros((n, windows, 6 * h))
    for k, d in enumerate(DIRECTIONS):
        u, d_u = params["u" + d], np.zeros_like(params["u" + d])
        carried = np.zeros((windows, h))
        for t in reversed(_steps(n, d)):
            state, update, reset, candidate, r = tape[d, t]
            total = carried + d_states[t, :, h * k:h * (k + 1)]
            live = mask[t][:, None]
            d_new = np.where(live, total, 0)
            d_candidate = d_new * (1 - update) * (1 - candidate**2)
            d_update = d_new * (state - candidate) * update * (1 - update)
            d_reset = d_candidate * r * reset * (1 - reset)
            d_projected[t, :, 3 * h * k:3 * h * (k + 1)] = np.hstack((d_update, d_reset, d_candidate))
            d_r = np.hstack((d_update, d_reset, d_candidate * reset))
            d_u += state.T @ d_r
            carried = d_r @ u.T + d_new * update + np.where(live, 0, total)
        grads["u" + d] = d_u
    return grads, d_projected


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t))
                               / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8))
