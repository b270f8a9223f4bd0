"""A small bidirectional gated recurrent network with attention pooling, in numpy: forward, gradients, training."""

from __future__ import annotations

import numpy as np

HIDDEN = 8
Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_params(inputs: int, rng: np.random.Generator, hidden: int = HIDDEN) -> Params:
    """Weights of both directions (f, b), the attention and the output."""
    draw = lambda *shape: (rng.standard_normal(shape) * (0.5 / np.sqrt(shape[0]))).astype(np.float32)
    params: Params = {}
    for d in "fb":
        params[f"W{d}"] = draw(inputs, 3 * hidden)
        params[f"U{d}"] = draw(hidden, 3 * hidden)
        params[f"c{d}"] = np.zeros(3 * hidden, np.float32)
    params["A"], params["a"], params["v"] = draw(2 * hidden, hidden), np.zeros(hidden, np.float32), draw(hidden)
    params["o"], params["p"] = draw(2 * hidden), np.zeros(1, np.float32)
    return params


def _run(gates, mask, U, hidden: int, reverse: bool, keep: list | None):
    """States of one direction; ``gates`` holds the input's part of update, reset and candidate by step."""
    steps, n = mask.shape
    state = np.zeros((n, hidden), np.float32)
    states = np.empty((steps, n, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        inner = state @ U
        both = _sigmoid(gates[t, :, : 2 * hidden] + inner[:, : 2 * hidden])
        update, reset = both[:, :hidden], both[:, hidden:]
        candidate = np.tanh(gates[t, :, 2 * hidden :] + reset * inner[:, 2 * hidden :])
        live = mask[t][:, None]
        new = state + live * (1 - update) * (candidate - state)
        if keep is not None:
            keep.append((t, state, inner, update, reset, candidate))
        states[t] = state = new
    return states


def forward(gates_f, gates_b, mask, params: Params, cache: dict | None = None) -> np.ndarray:
    """One logit per window; ``gates_*`` are (step, window, 3 * hidden), ``mask`` is (step, window) of 0 and 1."""
    hidden = params["Uf"].shape[0]
    kept_f, kept_b = ([], []) if cache is not None else (None, None)
    h = np.concatenate(
        (
            _run(gates_f, mask, params["Uf"], hidden, False, kept_f),
            _run(gates_b, mask, params["Ub"], hidden, True, kept_b),
        ),
        axis=2,
    )
    u = np.tanh(h @ params["A"] + params["a"])
    e = np.where(mask > 0, u @ params["v"], -1e9)
    weight = np.exp(e - e.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = (weight[:, :, None] * h).sum(axis=0)
    if cache is not None:
        cache.update(h=h, u=u, weight=weight, pooled=pooled, kept_f=kept_f, kept_b=kept_b)
    return pooled @ params["o"] + params["p"][0]


def _back(kept, dstates, mask, U, hidden: int):
    """Gradients of one direction with respect to its gate inputs and to U."""
    steps, n = mask.shape
    dgates, dU = np.zeros((steps, n, 3 * hidden), np.float32), np.zeros_like(U)
    carry = np.zeros((n, hidden), np.float32)
    for t, state, inner, update, reset, candidate in reversed(kept):
        d = carry + dstates[t]
        live = mask[t][:, None]
        dcandidate = d * live * (1 - update) * (1 - candidate**2)
        dupdate = -d * live * (candidate - state) * update * (1 - update)
        dreset = dcandidate * inner[:, 2 * hidden :] * reset * (1 - reset)
        dgates[t] = np.concatenate((dupdate, dreset, dcandidate), axis=1)
        dinner = np.concatenate((dupdate, dreset, dcandidate * reset), axis=1)
        dU += state.T @ dinner
        carry = d * (1 - live * (1 - update)) + dinner @ U.T
    return dgates, dU


def gradients(x: np.ndarray, mask: np.ndarray, goal: np.ndarray, params: Params) -> tuple[Params, np.ndarray, float]:
    """Of the mean log loss over windows: by parameter, and by input ``x`` (step, window, inputs)."""
    cache: dict = {}
    gates = {d: x @ params[f"W{d}"] + params[f"c{d}"] for d in "fb"}
    logit = forward(gates["f"], gates["b"], mask, params, cache)
    chance = _sigmoid(logit)
    loss = float(-np.mean(goal * np.log(chance + 1e-7) + (1 - goal) * np.log(1 - chance + 1e-7)))
    dlogit = (chance - goal) / len(goal)
    hidden = params["Uf"].shape[0]
    h, u, weight = cache["h"], cache["u"], cache["weight"]
    out: Params = {"o": cache["pooled"].T @ dlogit, "p": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * params["o"]
    dh = weight[:, :, None] * dpooled
    dweight = (h * dpooled).sum(axis=2)
    de = weight * (dweight - (weight * dweight).sum(axis=0))
    out["v"] = np.tensordot(de, u, axes=((0, 1), (0, 1)))
    du = de[:, :, None] * params["v"] * (1 - u**2)
    out["A"], out["a"] = np.tensordot(h, du, axes=((0, 1), (0, 1))), du.sum(axis=(0, 1))
    dh = dh + du @ params["A"].T
    dx = np.zeros_like(x)
    for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        dgates, out[f"U{d}"] = _back(cache[f"kept_{d}"], dh[:, :, part], mask, params[f"U{d}"], hidden)
        out[f"W{d}"] = np.tensordot(x, dgates, axes=((0, 1), (0, 1)))
        out[f"c{d}"] = dgates.sum(axis=(0, 1))
        dx += dgates @ params[f"W{d}"].T
    return out, dx, loss


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.first, self.second = rate, 0, {}, {}

    def update(self, params: Params, grads: Params) -> None:
        self.step += 1
        for name, g in grads.items():
            m = self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * g
            v = self.second[name] = 0.999 * self.second.get(name, 0) + 0.001 * g * g
            m, v = m / (1 - 0.9**self.step), v / (1 - 0.999**self.step)
            params[name] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
