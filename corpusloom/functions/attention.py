"""Attention and gated linear recurrences in numpy: exact forms for small inputs."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def rms(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps)


def unit(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).sum(-1, keepdims=True) + eps)


def rotated(x: np.ndarray, base: float = 10_000.0) -> np.ndarray:
    """Pairs of neighbours turned by an angle that grows with the place."""
    n, d = x.shape
    angle = np.arange(n)[:, None] / base ** (np.arange(0, d, 2) / d)
    c, s = np.cos(angle), np.sin(angle)
    out = np.empty_like(x)
    out[:, 0::2], out[:, 1::2] = x[:, 0::2] * c - x[:, 1::2] * s, x[:, 0::2] * s + x[:, 1::2] * c
    return out


def attention(x: np.ndarray, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray, window: int, document: np.ndarray | None = None) -> np.ndarray:
    """Causal attention within a window and a document; queries and keys normalised and rotated."""
    q, k, v = rotated(rms(x @ wq)), rotated(rms(x @ wk)), x @ wv
    i = np.arange(len(x))
    seen = (i[None, :] <= i[:, None]) & (i[:, None] - i[None, :] < window)
    if document is not None:
        seen &= document[:, None] == document[None, :]
    return softmax(np.where(seen, q @ k.T / np.sqrt(q.shape[1]), -1e30)) @ v


def mlp(x: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return np.maximum(0, x @ up) ** 2 @ down


def block(x: np.ndarray, w: dict[str, np.ndarray], window: int, keep: float = 1.0, add: float = 1.0) -> np.ndarray:
    """A residual block: attention and then the perceptron, each on the normalised stream with coefficients of its own."""
    x = keep * x + add * attention(rms(x), w["q"], w["k"], w["v"], window)
    return keep * x + add * mlp(rms(x), w["up"], w["down"])


def delta_rule(q: np.ndarray, k: np.ndarray, v: np.ndarray, gate: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Step by step: the state is forgotten by the gate of each key dimension, then what it says of the key moves to the value by beta."""
    state = np.zeros((k.shape[1], v.shape[1]))
    out = np.empty((len(q), v.shape[1]))
    for t in range(len(q)):
        state = gate[t][:, None] * state
        state = state + beta[t] * np.outer(k[t], v[t] - k[t] @ state)
        out[t] = q[t] @ state
    return out


def delta_rule_in_chunks(q: np.ndarray, k: np.ndarray, v: np.ndarray, gate: np.ndarray, beta: np.ndarray, chunk: int = 16) -> np.ndarray:
    """The same by chunks: within a chunk the corrections solve a triangular system, and one product carries the state on."""
    state = np.zeros((k.shape[1], v.shape[1]))
    out = np.empty((len(q), v.shape[1]))
    for a in range(0, len(q), chunk):
        s = slice(a, min(len(q), a + chunk))
        log = np.cumsum(np.log(gate[s]), axis=0)
        kin, kout, qin = k[s] * np.exp(log), k[s] * np.exp(-log), q[s] * np.exp(log)
        n = len(kin)
        mix = np.tril(kin @ kout.T, -1) * beta[s][:, None]
        u = np.linalg.solve(np.eye(n) + mix, beta[s][:, None] * (v[s] - kin @ state))
        out[s] = qin @ state + np.tril(qin @ kout.T) @ u
        state = np.exp(log[-1])[:, None] * (state + kout.T @ u)
    return out


def causal_convolution(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each channel with its taps, the last one on the present, then x * sigmoid(x)."""
    n, taps = len(x), w.shape[0]
    padded = np.concatenate([np.zeros((taps - 1, x.shape[1])), x])
    z = sum(padded[j : j + n] * w[j] for j in range(taps))
    return z / (1 + np.exp(-z))
