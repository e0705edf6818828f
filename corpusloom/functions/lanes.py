"""The learners of ``online`` for many sequences side by side: a step of all sequences at a time, the numbers of one by one.

Sequences are lanes, the longest first, so those that still run are the first ``k``
rows of each state. Sums over weights go through one matrix product per lane, as
there, so that they round alike.
"""

from __future__ import annotations

import numpy as np

from corpusloom.functions.online import Lstm, Mixer, Refiner, history_table, squash, stretch

#: Lanes of a step, and the bytes of state that may make it fewer (of many symbols).
LANES, LANE_BYTES = 256, 1 << 26


def lanes_of(symbols: int) -> int:
    """How many sequences of so many symbols go side by side."""
    return max(1, min(LANES, LANE_BYTES // (1700 * symbols)))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.matmul(a[:, None, :], b[:, :, None])[:, 0, 0]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A matrix and a vector of each lane."""
    return np.matmul(a, b[:, :, None])[:, :, 0]


class HistoryLanes:
    """``HistoryMap``; a place is a context of a lane."""

    def __init__(self, lanes: int, places: int, rate: float = 0.02, limit: int = 255) -> None:
        states, nexts = history_table()
        self.nexts = np.array(nexts, np.int64)
        self.state = np.zeros(places, np.int64)
        self.p = np.tile([(b + 0.4) / (a + b + 0.8) for a, b in states], lanes)
        self.n = np.zeros(len(self.p), np.int64)
        self.first = np.arange(lanes) * len(states)
        self.rate, self.limit = rate, limit

    def predict(self, at: np.ndarray) -> np.ndarray:
        self.at, self.now = at, self.state[at]
        self.cell = self.first[: len(at)] + self.now
        return self.p[self.cell]

    def learn(self, bit: np.ndarray) -> None:
        n = np.minimum(self.limit, self.n[self.cell] + 1)
        p = self.p[self.cell]
        self.n[self.cell] = n
        self.p[self.cell] = p + (bit - p) * np.maximum(self.rate, 1.0 / (n + 1.5))
        self.state[self.at] = self.nexts[self.now, bit]


class RunLanes:
    """``RunHistory``, and how it is heard: 0.5 and the trust in a run of the context's own symbol, or against it."""

    def __init__(self, lanes: int, places: int) -> None:
        self.symbol, self.n = np.full(places, -1, np.int64), np.zeros(places, np.int64)
        self.hit = np.full(16 * lanes, 0.5)
        self.first = np.arange(lanes) * 16

    def predict(self, at: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        self.at, self.s, self.run = at, self.symbol[at], self.n[at]
        self.cell = self.first[: len(at)] + np.minimum(self.run, 15)
        return np.where(self.run > 0, 0.5 + np.where(self.s == ctx, 0.5, -0.5) * self.hit[self.cell], 0.5)

    def learn(self, symbol: np.ndarray) -> None:
        same, seen = self.s == symbol, self.run > 0
        cell = self.cell[seen]
        self.hit[cell] += (same[seen] - self.hit[cell]) * 0.05
        self.n[self.at] = np.where(same, self.run + 1, 1)
        self.symbol[self.at] = symbol


class StationaryLanes:
    """``StationaryMap`` without nodes."""

    def __init__(self, places: int, limit: int = 127) -> None:
        self.p, self.n, self.limit = np.full(places, 0.5), np.zeros(places, np.int64), limit

    def predict(self, at: np.ndarray) -> np.ndarray:
        self.at, self.now = at, self.p[at]
        return self.now

    def learn(self, bit: np.ndarray) -> None:
        n = np.minimum(self.limit, self.n[self.at] + 1)
        self.n[self.at] = n
        self.p[self.at] = self.now + (bit - self.now) / (n + 0.5)


class MixerLanes:
    """``Mixer``; contexts are numbered as they come, so those beyond ``most`` are known by their number."""

    def __init__(self, lanes: int, n: int, contexts: int, rate: float = 0.02) -> None:
        self.most, self.rate = Mixer(n).most, rate
        self.w = np.full((lanes, min(contexts, self.most), n), 1.0 / n)
        self.lane = np.arange(lanes)

    def predict(self, x: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        self.x, self.at = x, (self.lane[: len(x)], np.where(ctx < self.most, ctx, 0))
        self.row = self.w[self.at]
        self.p = squash(dot(self.row, x))
        return self.p

    def learn(self, bit: np.ndarray) -> None:
        self.w[self.at] = self.row + (self.rate * (bit - self.p))[:, None] * self.x


class RefinerLanes:
    """``Refiner``; a place is a context of a lane."""

    def __init__(self, places: int) -> None:
        one = Refiner()
        self.rate, self.last = one.rate, len(one.edges) - 1
        self.table = np.tile(squash(one.edges), (places, 1))

    def predict(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = (np.clip(stretch(p), -8, 8) + 8) / 16 * self.last
        k = np.minimum(x.astype(np.int64), self.last - 1)
        self.at, self.k, self.w = at, k, x - k
        self.low, self.high = self.table[at, k], self.table[at, k + 1]
        return self.low * (1 - self.w) + self.high * self.w

    def learn(self, bit: np.ndarray) -> None:
        self.table[self.at, self.k] = self.low + self.rate * (1 - self.w) * (bit - self.low)
        self.table[self.at, self.k + 1] = self.high + self.rate * self.w * (bit - self.high)


class SpecialistLanes:
    """``Specialist``."""

    def __init__(self, lanes: int, classes: int = 8) -> None:
        self.fine, self.coarse = np.zeros((lanes, classes, 5)), np.zeros((lanes, 5))
        self.lane = np.arange(lanes)

    def predict(self, p: np.ndarray, q: np.ndarray, cls: np.ndarray) -> np.ndarray:
        a, b = stretch(p), stretch(q)
        self.x, self.at = np.stack([np.ones(len(p)), a / 8, b / 8, (a - b) / 8, np.abs(a) / 8], 1), (self.lane[: len(p)], cls)
        self.row = self.fine[self.at]
        shift = np.clip(dot(self.row * 0.75 + self.coarse[: len(p)] * 0.25, self.x), -1.5, 1.5)
        self.out = squash(a + shift)
        return self.out

    def learn(self, bit: np.ndarray, rate: float = 0.02) -> None:
        err = rate * (bit - self.out)
        self.fine[self.at] = self.row + (0.75 * err)[:, None] * self.x
        self.coarse[: len(bit)] += (0.25 * err)[:, None] * self.x


class LstmLanes:
    """``Lstm``, whose weights begin alike in all lanes."""

    def __init__(self, lanes: int, symbols: int, cells: int) -> None:
        one = Lstm(symbols, cells)
        self.symbols, self.cells, self.horizon, self.rate = symbols, cells, one.horizon, one.rate
        self.w = {k: np.tile(v, (lanes, 1, 1)) for k, v in one.w.items()}
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.steps = 0
        self.h, self.c = np.zeros((lanes, cells)), np.zeros((lanes, cells))
        self.lane = np.arange(lanes)
        self.past: list[tuple] = []

    def predict(self, symbol: np.ndarray) -> np.ndarray:
        k, n, at = len(symbol), self.cells, self.lane[: len(symbol)]
        x = np.zeros((k, self.symbols + n + 1))
        x[at, symbol] = 1.0
        x[:, self.symbols : -1] = self.h[:k]
        x[:, -1] = 1.0
        z = times(self.w["gates"][:k], x)
        s, g = squash(z[:, : 3 * n]), np.tanh(z[:, 3 * n :].copy())
        f, i, o, c = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], self.c[:k]
        c2 = f * c + i * g
        t = np.tanh(c2)
        h = np.ones((k, n + 1))
        h[:, :n] = o * t
        z = times(self.w["out"][:k], h)
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        self.past.append((x, f, i, o, g, c, t, h, symbol, p))
        self.c, self.h = c2, h[:, :n]
        return p

    def learn(self, actual: np.ndarray) -> None:
        self.past[-1] += (actual,)
        if len(self.past) == self.horizon:
            self.update(self.gradients(len(actual)), len(actual))
            self.past = []

    def gradients(self, k: int) -> dict[str, np.ndarray]:
        """Of the first ``k`` lanes, which ran through the horizon."""
        out, gates = (self.w[name][:k] for name in ("out", "gates"))
        got = {"gates": np.zeros(gates.shape), "out": np.zeros(out.shape)}
        symbol_part, rest, at = got["gates"], got["gates"][:, :, self.symbols :], self.lane[:k]
        dh, dc = np.zeros((k, self.cells)), np.zeros((k, self.cells))
        for x, f, i, o, g, c, t, h, s, p, y in ([a[:k] for a in step] for step in reversed(self.past)):
            d = p.copy()
            d[at, y] -= 1.0
            got["out"] += d[:, :, None] * h[:, None, :]
            dh = dh + times(out[:, :, :-1].transpose(0, 2, 1), d)
            dc = dc + dh * o * (1 - t * t)
            dz = np.concatenate([dc * c * f * (1 - f), dc * g * i * (1 - i), dh * t * o * (1 - o), dc * i * (1 - g * g)], 1)
            symbol_part[at, :, s] += dz
            rest += dz[:, :, None] * x[:, None, self.symbols :]
            dh = times(gates.transpose(0, 2, 1), dz)[:, self.symbols : -1]
            dc = dc * f
        return got

    def update(self, grads: dict[str, np.ndarray], k: int, b1: float = 0.9, b2: float = 0.999) -> None:
        self.steps += 1
        for name, g in grads.items():
            np.clip(g, -2, 2, out=g)
            m, v = (a[:k] for a in self.moment[name])
            m *= b1
            m += (1 - b1) * g
            v *= b2
            v += (1 - b2) * g * g
            self.w[name][:k] -= self.rate * (m / (1 - b1**self.steps)) / (np.sqrt(v / (1 - b2**self.steps)) + 1e-8)


def numbered(sequence: np.ndarray, codes: np.ndarray, sequences: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of sequences that lie one after another, numbered from 0 as they first occur in their sequence; and how many each has."""
    key, first, back = np.unique(sequence * (int(codes.max(initial=0)) + 1) + codes, return_index=True, return_inverse=True)
    order = np.argsort(first)
    owner = sequence[first]
    known = np.bincount(owner, minlength=sequences)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - (np.cumsum(known) - known)[owner[order]]
    return rank[back], known


def code_lengths(ids: np.ndarray, bits: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """For each sequence the bits of its repeats by the mixers, refined, corrected, and of its symbols by the recurrent net.

    Sequences lie one after another; their ids are ``numbered``, and below ``symbols``.
    """
    lanes = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)
    lane = np.repeat(place, lengths)
    step = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # what each place but a sequence's first knows: the last symbol, the last two (as one number), the last bit
    at = np.flatnonzero(step)
    one = ids[at - 1]
    two = one * 64 + np.where(step[at] > 1, ids[at - 2], 63)
    two = np.unique(lane[at] * (int(two.max(initial=0)) + 1) + two, return_inverse=True)[1]
    by = np.lexsort((lane[at], step[at]))
    at, one, two = at[by], one[by], two[by]
    symbol, bit, last = ids[at], bits[at], bits[at - 1]
    ends = np.cumsum(np.bincount(step[at])[1:]).tolist() if len(at) else []

    hist, pair = HistoryLanes(lanes, lanes * symbols), HistoryLanes(lanes, int(two.max(initial=-1)) + 1)
    still, runs = StationaryLanes(lanes * symbols), RunLanes(lanes, lanes * symbols)
    mixers, top = (MixerLanes(lanes, 5, symbols), MixerLanes(lanes, 5, 2)), MixerLanes(lanes, 2, 1, 0.02 / 4)
    refine, special, net = RefinerLanes(lanes * symbols), SpecialistLanes(lanes), LstmLanes(lanes, symbols, 8)
    total = np.zeros((4, lanes))
    start = 0
    for end in ends:
        s, k = slice(start, end), end - start
        start = end
        c1, y, now = one[s], bit[s], symbol[s]
        mine = np.arange(k)
        cell = mine * symbols + c1
        said = (hist.predict(cell), pair.predict(two[s]), still.predict(cell), runs.predict(cell, c1), np.full(k, 0.3))
        x = stretch(np.stack(said, 1))
        mid = stretch(np.stack([m.predict(x, c) for m, c in zip(mixers, (c1, last[s]), strict=True)], 1))
        p = top.predict(mid, np.zeros(k, np.int64))
        q = refine.predict(p, cell)
        z = special.predict(q, p, c1 % 8)
        dist = net.predict(c1)
        for t, v in zip(total, (p, q, z), strict=False):
            t[:k] -= np.log2(np.minimum(1, np.maximum(1e-9, np.where(y == 1, v, 1 - v))))
        total[3, :k] -= np.log2(np.maximum(1e-9, dist[mine, now]))
        for m in (*mixers, top, refine, special, hist, pair, still):
            m.learn(y)
        runs.learn(now)
        net.learn(now)
    return total.T[place]
