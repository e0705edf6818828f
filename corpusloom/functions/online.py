"""Online learners over one sequence: bit histories, adaptive maps, gated mixers, secondary estimation, a small recurrent net.

Each predicts from the past and then learns from what came (``predict`` before
``learn``). State belongs to one sequence; nothing is shared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(4)
def history_table(limit: int = 40, discount: bool = True) -> tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]:
    """States (zeros, ones) that are reached from (0, 0), and for each the numbers of the states after a 0 and after a 1.

    A bit adds one to its own count, up to a bound that shrinks as the other count
    grows; a long run of the other bit is discounted: of more than two, half and one stay.
    """

    def after(state: tuple[int, int], bit: int) -> tuple[int, int]:
        own, other = state[bit], state[1 - bit]
        if discount and other > 2:
            other = other // 2 + 1
        own = min(own + 1, max(3, limit // (1 + other)))
        return (own, other) if bit == 0 else (other, own)

    states, number, nexts = [(0, 0)], {(0, 0): 0}, []
    for s in states:
        row = []
        for bit in (0, 1):
            t = after(s, bit)
            if t not in number:
                number[t] = len(states)
                states.append(t)
            row.append(number[t])
        nexts.append((row[0], row[1]))
    return tuple(states), tuple(nexts)


class HistoryMap:
    """Context to bit history, history to probability: the second level is shared by all contexts."""

    def __init__(self, rate: float = 0.02, limit: int = 255) -> None:
        self.states, self.nexts = history_table()
        self.state: dict[int, int] = {}
        self.p = np.array([(b + 0.4) / (a + b + 0.8) for a, b in self.states])
        self.n = np.zeros(len(self.states), int)
        self.rate, self.limit = rate, limit

    def predict(self, ctx: int) -> float:
        return float(self.p[self.state.get(ctx, 0)])

    def learn(self, ctx: int, bit: int) -> None:
        s = self.state.get(ctx, 0)
        self.n[s] = min(self.limit, self.n[s] + 1)
        self.p[s] += (bit - self.p[s]) * max(self.rate, 1.0 / (self.n[s] + 1.5))
        self.state[ctx] = self.nexts[s][bit]


class RunHistory:
    """Context to the symbol seen last and how often in a row; the confidence of a run is learned by its length."""

    def __init__(self) -> None:
        self.run: dict[int, tuple[int, int]] = {}
        self.hit = np.full(16, 0.5)

    def predict(self, ctx: int) -> tuple[int | None, float]:
        s, n = self.run.get(ctx, (None, 0))
        return s, float(self.hit[min(n, 15)]) if n else 0.0

    def learn(self, ctx: int, symbol: int) -> None:
        s, n = self.run.get(ctx, (None, 0))
        if n:
            k = min(n, 15)
            self.hit[k] += ((s == symbol) - self.hit[k]) * 0.05
        self.run[ctx] = (symbol, n + 1 if s == symbol else 1)


class StationaryMap:
    """(context, node) to a running mean whose rate falls to a bound."""

    def __init__(self, limit: int = 127) -> None:
        self.p: dict[tuple[int, int], tuple[float, int]] = {}
        self.limit = limit

    def predict(self, ctx: int, node: int = 0) -> float:
        return self.p.get((ctx, node), (0.5, 0))[0]

    def learn(self, ctx: int, bit: int, node: int = 0) -> None:
        p, n = self.p.get((ctx, node), (0.5, 0))
        n = min(self.limit, n + 1)
        self.p[ctx, node] = p + (bit - p) / (n + 0.5), n


def stretch(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def squash(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Logistic mixing with a row of weights for each selected context; beyond ``most`` contexts the first row serves."""

    def __init__(self, n: int, rate: float = 0.02, most: int = 10_000, decay: float = 0.0) -> None:
        self.n, self.rate, self.most, self.decay = n, rate, most, decay
        self.rows: dict[int, np.ndarray] = {0: np.full(n, 1.0 / n)}
        self.steps = 0

    def row(self, ctx: int) -> np.ndarray:
        if ctx not in self.rows:
            if len(self.rows) >= self.most:
                return self.rows[0]
            self.rows[ctx] = np.full(self.n, 1.0 / self.n)
        return self.rows[ctx]

    def predict(self, x: np.ndarray, ctx: int = 0) -> float:
        return float(squash(self.row(ctx) @ x))

    def learn(self, x: np.ndarray, bit: int, ctx: int = 0) -> None:
        w = self.row(ctx)
        self.steps += 1
        w += self.rate / (1 + self.decay * self.steps) * (bit - self.predict(x, ctx)) * x


class Layered:
    """Mixers selected by several contexts, and one that mixes their outputs."""

    def __init__(self, n: int, selectors: int, rate: float = 0.02) -> None:
        self.first = [Mixer(n, rate) for _ in range(selectors)]
        self.last = Mixer(selectors, rate / 4)

    def predict(self, x: np.ndarray, ctx: list[int]) -> float:
        self.x, self.ctx = x, ctx
        self.mid = np.array([stretch(m.predict(x, c)) for m, c in zip(self.first, ctx, strict=True)])
        return self.last.predict(self.mid)

    def learn(self, bit: int) -> None:
        for m, c in zip(self.first, self.ctx, strict=True):
            m.learn(self.x, bit, c)
        self.last.learn(self.mid, bit)


class Refiner:
    """Secondary estimation: (context, bucket of the logit) to a probability, read between two buckets."""

    def __init__(self, buckets: int = 33, rate: float = 0.02) -> None:
        self.edges = np.linspace(-8, 8, buckets)
        self.table: dict[int, np.ndarray] = {}
        self.rate = rate

    def place(self, p: float) -> tuple[int, float]:
        x = (float(np.clip(stretch(p), -8, 8)) + 8) / 16 * (len(self.edges) - 1)
        k = min(int(x), len(self.edges) - 2)
        return k, x - k

    def predict(self, p: float, ctx: int = 0) -> float:
        t = self.table.setdefault(ctx, squash(self.edges))
        k, w = self.place(p)
        return float(t[k] * (1 - w) + t[k + 1] * w)

    def learn(self, p: float, bit: int, ctx: int = 0) -> None:
        t = self.table.setdefault(ctx, squash(self.edges))
        k, w = self.place(p)
        t[k] += self.rate * (1 - w) * (bit - t[k])
        t[k + 1] += self.rate * w * (bit - t[k + 1])


class Specialist:
    """A correction of the logit from five features, learned fine and coarse, and never beyond 1.5."""

    def __init__(self, classes: int = 8) -> None:
        self.fine, self.coarse = np.zeros((classes, 5)), np.zeros(5)

    def features(self, p: float, q: float) -> np.ndarray:
        a, b = float(stretch(p)), float(stretch(q))
        return np.array([1.0, a / 8, b / 8, (a - b) / 8, abs(a) / 8])

    def predict(self, p: float, q: float, cls: int) -> float:
        self.x, self.cls, self.p = self.features(p, q), cls, p
        shift = float(np.clip((self.fine[cls] * 0.75 + self.coarse * 0.25) @ self.x, -1.5, 1.5))
        self.out = float(squash(stretch(p) + shift))
        return self.out

    def learn(self, bit: int, rate: float = 0.02) -> None:
        err = rate * (bit - self.out)
        self.fine[self.cls] += 0.75 * err * self.x
        self.coarse += 0.25 * err * self.x


def byte_to_bit(p: np.ndarray, node: int, depth: int) -> float:
    """From a distribution of 256 bytes, the probability that the next bit is 1 after ``depth`` bits that make ``node``."""
    width = 256 >> depth
    lo = (node << 8 - depth) & 255
    zero, one = p[lo : lo + width // 2].sum(), p[lo + width // 2 : lo + width].sum()
    return float(one / (zero + one)) if zero + one > 0 else 0.5


def within(p: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The distribution without bytes outside the vocabulary."""
    q = np.where(vocabulary, p, 0.0)
    return q / q.sum() if q.sum() else vocabulary / vocabulary.sum()


def scattered(p: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Probabilities of a vocabulary's values at their bytes."""
    out = np.zeros(256)
    out[values] = p
    return out


class Lstm:
    """One layer of gated cells over one-hot symbols, a softmax on top; trained by truncated backpropagation with Adam."""

    def __init__(self, symbols: int, cells: int = 16, horizon: int = 8, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.symbols, self.cells, self.horizon, self.rate = symbols, cells, horizon, rate
        self.w = {"gates": rng.normal(0, 0.2, (4 * cells, symbols + cells + 1)), "out": rng.normal(0, 0.2, (symbols, cells + 1))}
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.steps = 0
        self.h, self.c = np.zeros(cells), np.zeros(cells)
        self.past: list[tuple] = []

    def forward(self, symbol: int, h: np.ndarray, c: np.ndarray) -> tuple:
        x = np.zeros(self.symbols + self.cells + 1)
        x[symbol] = 1.0
        x[self.symbols : -1] = h
        x[-1] = 1.0
        z = self.w["gates"] @ x
        n = self.cells
        f, i, o, g = squash(z[:n]), squash(z[n : 2 * n]), squash(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
        c2 = f * c + i * g
        return x, f, i, o, g, c, c2, o * np.tanh(c2)

    def predict(self, symbol: int) -> np.ndarray:
        """The distribution of the next symbol after this one."""
        step = self.forward(symbol, self.h, self.c)
        self.c, self.h = step[6], step[7]
        z = self.w["out"] @ np.append(self.h, 1.0)
        z = np.exp(z - z.max())
        self.past.append((step, z / z.sum()))
        return z / z.sum()

    def learn(self, actual: int) -> None:
        step, p = self.past[-1]
        self.past[-1] = (step, p, actual)
        if len(self.past) == self.horizon:
            self.update(self.gradients(self.past))
            self.past = []

    def gradients(self, past: list[tuple]) -> dict[str, np.ndarray]:
        out = {k: np.zeros_like(v) for k, v in self.w.items()}
        dh, dc = np.zeros(self.cells), np.zeros(self.cells)
        for (x, f, i, o, g, c, c2, h), p, y in reversed(past):
            d = p.copy()
            d[y] -= 1.0
            out["out"] += np.outer(d, np.append(h, 1.0))
            dh = dh + self.w["out"][:, :-1].T @ d
            t = np.tanh(c2)
            dc = dc + dh * o * (1 - t * t)
            dz = np.concatenate([dc * c * f * (1 - f), dc * g * i * (1 - i), dh * t * o * (1 - o), dc * i * (1 - g * g)])
            out["gates"] += np.outer(dz, x)
            dh = (self.w["gates"].T @ dz)[self.symbols : -1]
            dc = dc * f
        return out

    def update(self, grads: dict[str, np.ndarray], b1: float = 0.9, b2: float = 0.999) -> None:
        self.steps += 1
        for k, g in grads.items():
            g = np.clip(g, -2, 2)
            m, v = self.moment[k]
            m[...] = b1 * m + (1 - b1) * g
            v[...] = b2 * v + (1 - b2) * g * g
            self.w[k] -= self.rate * (m / (1 - b1**self.steps)) / (np.sqrt(v / (1 - b2**self.steps)) + 1e-8)
