"""Prediction by partial matching over bytes: a blended distribution with exclusion and learned escapes.

From the longest known context down, each gives its symbols their shares and the rest
as an escape to the next shorter one, which leaves out what was already named; below
order 0 all bytes are alike. How likely an escape is, is learned by (order, number of
symbols, whether the context is new to repeating itself). Counts are halved when they
grow; contexts seen once are cut when there are too many.
"""

from __future__ import annotations

import math

import numpy as np


class Ppm:
    def __init__(self, order: int = 5, symbols: int = 256, most: int = 200_000, limit: int = 250) -> None:
        self.order, self.symbols, self.most, self.limit = order, symbols, most, limit
        self.contexts: dict[bytes, dict[int, int]] = {b"": {}}
        self.escape: dict[tuple[int, int, bool], list[float]] = {}
        self.past = b""
        self.nested = True  # what a context has seen, shorter ones have too; until contexts are cut

    def key(self, k: int, own: dict[int, int]) -> tuple[int, int, bool]:
        return k, min(len(own), 8), sum(own.values()) > 2 * len(own)

    def escape_share(self, k: int, own: dict[int, int]) -> float:
        """Learned share of escapes, from (n symbols) / (n symbols + n counts) where nothing was learned."""
        n, e = self.escape.get(self.key(k, own), (0.0, 0.0))
        prior = len(own) / (len(own) + sum(own.values()))
        return min(0.999, max(0.001, (e + 2 * prior) / (n + 2)))

    def chain(self) -> list[tuple[int, dict[int, int]]]:
        """Known contexts of the past, the longest first."""
        out = []
        for k in range(min(self.order, len(self.past)), -1, -1):
            own = self.contexts.get(self.past[len(self.past) - k :])
            if own:
                out.append((k, own))
        return out

    def predict(self) -> np.ndarray:
        p = np.zeros(self.symbols)
        left, named = 1.0, np.zeros(self.symbols, bool)
        for k, own in self.chain():
            live = [(s, n) for s, n in own.items() if not named[s]]
            if not live:
                continue
            esc = self.escape_share(k, own) if named.sum() + len(live) < self.symbols else 0.0
            total = sum(n for _, n in live)
            for s, n in live:
                p[s] += left * (1 - esc) * n / total
                named[s] = True
            left *= esc
        free = ~named
        if free.any():
            p[free] += left / free.sum()
        return p / p.sum()

    def learn(self, symbol: int) -> None:
        for k, own in self.chain():
            e = self.escape.setdefault(self.key(k, own), [0.0, 0.0])
            e[0] += 1
            e[1] += symbol not in own
            if e[0] > 500:
                e[0], e[1] = e[0] / 2, e[1] / 2
            if symbol in own:
                break
        for k in range(min(self.order, len(self.past)) + 1):
            own = self.contexts.setdefault(self.past[len(self.past) - k :], {})
            own[symbol] = own.get(symbol, 0) + 1
            if own[symbol] > self.limit:
                for s in list(own):
                    own[s] = max(1, own[s] // 2)
        self.past = (self.past + bytes([symbol]))[-self.order :] if self.order else b""
        if len(self.contexts) > self.most:
            self.cut()

    def cut(self) -> None:
        """Drops contexts that were seen once; where that isn't half of them, the longest ones."""
        few = {c: own for c, own in self.contexts.items() if not c or sum(own.values()) > 1}
        if len(few) > self.most // 2:
            few = dict(sorted(few.items(), key=lambda x: (len(x[0]), -sum(x[1].values())))[: self.most // 2])
        self.contexts = few
        self.nested = False

    def bits(self, raw: bytes) -> float:
        """Code length of what comes, learned on the way.

        The same numbers as by ``predict`` and ``learn``, without the 255 shares that
        aren't asked for: one walk down the contexts ends where the byte is found, and
        what longer contexts named is taken off a context's total.
        """
        log2, order, limit, escape, symbols = math.log2, self.order, self.limit, self.escape, self.symbols
        contexts, nested, total = self.contexts, self.nested, 0.0
        sums = {c: sum(own.values()) for c, own in contexts.items()}
        before = self.past
        text = before + raw
        for at in range(len(before), len(text)):
            symbol, deep = text[at], min(order, at)
            left, named, p = 1.0, None, 0.0
            keys = [text[at - k : at] for k in range(deep, -1, -1)]
            for k, c in zip(range(deep, -1, -1), keys, strict=True):
                own = contexts.get(c)
                if not own:
                    continue
                size, whole = len(own), sums[c]
                live, live_total = size, whole
                if named:
                    if nested:
                        live -= len(named)
                        live_total -= sum(map(own.__getitem__, named))
                    else:
                        for s in named:
                            n = own.get(s)
                            if n:
                                live -= 1
                                live_total -= n
                found = own.get(symbol)
                key = (k, size if size < 8 else 8, whole > 2 * size)
                e = escape.get(key)
                if e is None:
                    e = escape[key] = [0.0, 0.0]
                if live:
                    if (len(named) if named else 0) + live < symbols:
                        esc = min(0.999, max(0.001, (e[1] + 2 * (size / (size + whole))) / (e[0] + 2)))
                    else:
                        esc = 0.0
                    if found:
                        p = left * (1 - esc) * found / live_total
                    else:
                        left *= esc
                e[0] += 1
                if not found:
                    e[1] += 1
                if e[0] > 500:
                    e[0], e[1] = e[0] / 2, e[1] / 2
                if found:
                    break
                named = own.keys() if nested or not named else named | own.keys()
            else:
                p = left / (symbols - (len(named) if named else 0))
            total -= log2(p)
            for c in keys:
                own = contexts.get(c)
                if own is None:
                    contexts[c] = {symbol: 1}
                    sums[c] = 1
                    continue
                n = own[symbol] = own.get(symbol, 0) + 1
                sums[c] = sums.get(c, 0) + 1
                if n > limit:
                    for s in own:
                        own[s] = max(1, own[s] // 2)
                    sums[c] = sum(own.values())
            if len(contexts) > self.most:
                self.past = text[at + 1 - order : at + 1] if order else b""
                self.cut()
                contexts, nested = self.contexts, self.nested
                sums = {c: sums[c] for c in contexts}
        self.past = text[max(0, len(text) - order) :] if order else b""
        return total
