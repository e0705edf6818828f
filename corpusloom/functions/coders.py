"""Byte-wise range coding of symbols by frequencies, and of bits by adaptive probabilities.

Both coders keep a 56-bit interval that is never narrower than 48 bits; a carry goes back
into the bytes written. So a symbol costs its share but for a factor of total / 2^48, and
a code is shorter than these costs and four bytes. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import numpy as np

#: Bits of the interval, its least width, and its bits that the last four bytes leave out.
WIDTH, LEAST, REST = 56, 1 << 48, 24
MASK = (1 << WIDTH) - 1


class RangeEncoder:
    """Symbols as shares [lo, hi) of a total up to 2^32."""

    def __init__(self) -> None:
        self.low, self.range, self.out = 0, MASK, bytearray()

    def carry(self) -> None:
        k = len(self.out) - 1
        while self.out[k] == 255:
            self.out[k] = 0
            k -= 1
        self.out[k] += 1

    def put(self, lo: int, hi: int, total: int) -> None:
        step = self.range // total
        self.low += step * lo
        self.range = step * (hi - lo) if hi < total else self.range - step * lo
        if self.low > MASK:
            self.low &= MASK
            self.carry()
        while self.range < LEAST:
            self.out.append(self.low >> WIDTH - 8)
            self.low, self.range = self.low << 8 & MASK, self.range << 8

    def finish(self) -> bytes:
        """What was written, and four bytes of a number within the interval."""
        last = self.low + (1 << REST) - 1 >> REST
        if last >> 32:
            self.carry()
        return bytes(self.out) + (last & (1 << 32) - 1).to_bytes(4, "big")


class RangeDecoder:
    """Zeros follow a code; ``at`` is how many of its bytes the symbols read so far need."""

    def __init__(self, code: bytes) -> None:
        self.code, self.at = code, 4
        self.range, self.x = MASK, int.from_bytes(code[: WIDTH // 8].ljust(WIDTH // 8, b"\0"), "big")

    def peek(self, total: int) -> int:
        """A number within the share of the next symbol."""
        return min(total - 1, self.x // (self.range // total))

    def take(self, lo: int, hi: int, total: int) -> None:
        step = self.range // total
        self.x -= step * lo
        self.range = step * (hi - lo) if hi < total else self.range - step * lo
        while self.range < LEAST:
            k = self.at + REST // 8
            self.x, self.range = self.x << 8 | (self.code[k] if k < len(self.code) else 0), self.range << 8
            self.at += 1


def cumulative(freq: list[int]) -> list[int]:
    return [0, *np.cumsum(freq).tolist()]


def encode_symbols(symbols: list[int], freq: list[int]) -> bytes:
    """By fixed frequencies; a symbol of frequency 0 can't be coded."""
    cum, enc = cumulative(freq), RangeEncoder()
    for s in symbols:
        if not freq[s]:
            raise ValueError(f"symbol {s} has no frequency")
        enc.put(cum[s], cum[s + 1], cum[-1])
    return enc.finish()


def decode_symbols(code: bytes, n: int, freq: list[int]) -> list[int]:
    cum, dec, out = cumulative(freq), RangeDecoder(code), []
    edges = np.array(cum[1:])
    for _ in range(n):
        s = int(np.searchsorted(edges, dec.peek(cum[-1]), side="right"))
        dec.take(cum[s], cum[s + 1], cum[-1])
        out.append(s)
    return out


class Counts:
    """Adaptive frequencies of one context, from ones; halved when they reach the limit."""

    def __init__(self, n: int, limit: int = 1 << 13) -> None:
        self.n, self.limit = [1] * n, limit

    def add(self, s: int) -> None:
        self.n[s] += 1
        if sum(self.n) >= self.limit:
            self.n = [max(1, x // 2) for x in self.n]


def encode_adaptive(symbols: list[int], contexts: list[int], size: int) -> bytes:
    """By adaptive counts of each context."""
    known: dict[int, Counts] = {}
    enc = RangeEncoder()
    for s, c in zip(symbols, contexts, strict=True):
        own = known.setdefault(c, Counts(size))
        lo = sum(own.n[:s])
        enc.put(lo, lo + own.n[s], sum(own.n))
        own.add(s)
    return enc.finish()


def decode_adaptive(code: bytes, n: int, context, size: int) -> list[int]:  # noqa: ANN001
    """``context`` maps what was decoded to the context of the next symbol."""
    known: dict[int, Counts] = {}
    dec, out = RangeDecoder(code), []
    for _ in range(n):
        own = known.setdefault(context(out), Counts(size))
        total, at, s = sum(own.n), 0, 0
        t = dec.peek(total)
        while at + own.n[s] <= t:
            at += own.n[s]
            s += 1
        dec.take(at, at + own.n[s], total)
        own.add(s)
        out.append(s)
    return out


#: Bits of a probability, and how fast it follows.
P_BITS, P_RATE = 11, 5


class BitTree:
    """Symbols of ``bits`` bits, coded from the highest; a probability for each node."""

    def __init__(self, bits: int) -> None:
        self.bits, self.p = bits, [1 << P_BITS - 1] * (1 << bits)

    def step(self, node: int, bit: int) -> None:
        p = self.p[node]
        self.p[node] = p - (p >> P_RATE) if bit else p + ((1 << P_BITS) - p >> P_RATE)


def encode_bits(symbols: list[int], bits: int = 4, contexts: list[int] | None = None) -> bytes:
    """Binary coding of symbols by trees, one for each context."""
    trees: dict[int, BitTree] = {}
    enc = RangeEncoder()
    for k, s in enumerate(symbols):
        tree = trees.setdefault(contexts[k] if contexts else 0, BitTree(bits))
        node = 1
        for j in range(bits - 1, -1, -1):
            bit = s >> j & 1
            zero = tree.p[node]
            enc.put(zero if bit else 0, 1 << P_BITS if bit else zero, 1 << P_BITS)
            tree.step(node, bit)
            node = node << 1 | bit
    return enc.finish()


def decode_bits(code: bytes, n: int, bits: int = 4, context=None) -> list[int]:  # noqa: ANN001
    """The inverse; more bytes than the symbols need is an error."""
    trees: dict[int, BitTree] = {}
    dec, out = RangeDecoder(code), []
    for _ in range(n):
        tree = trees.setdefault(context(out) if context else 0, BitTree(bits))
        node = 1
        for _ in range(bits):
            zero = tree.p[node]
            bit = int(dec.peek(1 << P_BITS) >= zero)
            dec.take(zero if bit else 0, 1 << P_BITS if bit else zero, 1 << P_BITS)
            tree.step(node, bit)
            node = node << 1 | bit
        out.append(node - (1 << bits))
    if dec.at < len(code):
        raise ValueError(f"{len(code) - dec.at} bytes are left over")
    return out


def bf16_bits(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of float32, rounded to even; a NaN stays one."""
    b = np.asarray(x, np.float32).view(np.uint32)
    up = (b + np.uint32(0x7FFF) + ((b >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)
    return np.where(np.isnan(x), (b >> np.uint32(16)) | np.uint32(64), up).astype(np.uint16)


def bf16_values(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << np.uint32(16)).view(np.float32)


def uvarint(n: int) -> bytes:
    """Seven bits a byte, the lowest first; all but the last have the top bit."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uvarint(raw: bytes, at: int) -> tuple[int, int]:
    """The number, and the place behind it."""
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7
