"""Files of named tensors, stream headers, and what they check when they are read.

A tensor file is: magic, version, number of tensors; for each its name, type, shape, the
way its values are coded, the bytes; at the end a CRC-32 of all before. Versions differ
in the codings a writer may choose: 0 raw bytes only, 1 int8 of 15 levels at equal
frequencies, 2 adaptive counts, 4 the shortest of all for each tensor.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from corpusloom.functions import coders

MAGIC = b"CLTN"
TYPES = (np.int8, np.uint16, np.float32, np.int32)
VERSIONS = {0: (0,), 1: (0, 1), 2: (0, 2, 3), 4: (0, 1, 2, 3, 4)}
LEVELS = 15


@dataclass
class Tensor:
    name: str
    values: np.ndarray


def levels(t: np.ndarray) -> list[int] | None:
    """Values as symbols from 0, where all are within 15 levels around zero."""
    flat = t.ravel()
    return (flat.astype(int) + 7).tolist() if t.dtype == np.int8 and (not len(flat) or np.abs(flat.astype(int)).max() <= 7) else None


def before(out: list[int]) -> int:
    return out[-1] if out else 7


CODINGS: dict[int, tuple[Callable, Callable]] = {
    1: (lambda s: coders.encode_symbols(s, [1] * LEVELS), lambda c, n: coders.decode_symbols(c, n, [1] * LEVELS)),
    2: (lambda s: coders.encode_adaptive(s, [0] * len(s), LEVELS), lambda c, n: coders.decode_adaptive(c, n, lambda out: 0, LEVELS)),
    3: (lambda s: coders.encode_adaptive(s, [7, *s][: len(s)], LEVELS), lambda c, n: coders.decode_adaptive(c, n, before, LEVELS)),
    4: (lambda s: coders.encode_bits(s, 4, [7, *s][: len(s)]), lambda c, n: coders.decode_bits(c, n, 4, before)),
}


def coded(t: np.ndarray, version: int) -> tuple[int, bytes]:
    """The coding and the bytes of a tensor: the shortest that the version allows, the lowest number of equals."""
    tries = [(len(t.tobytes()), 0, t.tobytes())]
    s = levels(t)
    if s is not None:
        tries += [(len(c), k, c) for k in VERSIONS[version][1:] for c in [CODINGS[k][0](s)]]
    if version in (1, 2) and len(tries) > 1:
        tries = tries[1:]
    _, k, raw = min(tries, key=lambda x: x[:2])
    return k, raw


def write_tensors(tensors: list[Tensor], version: int = 0) -> bytes:
    out = bytearray(MAGIC + struct.pack("<BI", version, len(tensors)))
    for t in tensors:
        name = t.name.encode()
        kind = next((k for k, x in enumerate(TYPES) if t.values.dtype == x), None)
        if kind is None:
            raise ValueError(f"{t.name}: {t.values.dtype} has no type number")
        way, raw = coded(t.values, version)
        out += struct.pack("<H", len(name)) + name + struct.pack("<BB", kind, t.values.ndim)
        out += struct.pack(f"<{t.values.ndim}I", *t.values.shape) + struct.pack("<BI", way, len(raw)) + raw
    return bytes(out) + struct.pack("<I", zlib.crc32(out))


def read_tensors(raw: bytes) -> list[Tensor]:
    """Fails on a wrong magic or check sum, a repeated name, an unknown type and bytes left over."""
    if raw[:4] != MAGIC:
        raise ValueError("no tensor file")
    if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("the check sum is wrong")
    version, n = struct.unpack_from("<BI", raw, 4)
    at, out, names = 9, [], set()
    for _ in range(n):
        (size,) = struct.unpack_from("<H", raw, at)
        name = raw[at + 2 : at + 2 + size].decode()
        at += 2 + size
        kind, ndim = struct.unpack_from("<BB", raw, at)
        shape = struct.unpack_from(f"<{ndim}I", raw, at + 2)
        way, length = struct.unpack_from("<BI", raw, at + 2 + 4 * ndim)
        at += 7 + 4 * ndim
        if name in names:
            raise ValueError(f"{name} is there twice")
        if kind >= len(TYPES) or way not in VERSIONS.get(version, ()):
            raise ValueError(f"{name}: type {kind} or coding {way} is unknown")
        names.add(name)
        part = raw[at : at + length]
        count = int(np.prod(shape, dtype=np.int64))
        values = np.frombuffer(part, TYPES[kind]) if way == 0 else (np.array(CODINGS[way][1](part, count)) - 7).astype(np.int8)
        if len(values) != count:
            raise ValueError(f"{name}: {len(values)} values instead of {count}")
        out.append(Tensor(name, values.reshape(shape)))
        at += length
    if at != len(raw) - 4:
        raise ValueError("bytes are left over")
    return out


class TensorFile:
    """Tensors by name; type and shape are checked at each access."""

    def __init__(self, raw: bytes) -> None:
        self.tensors = {t.name: t.values for t in read_tensors(raw)}

    def get(self, name: str, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
        if name not in self.tensors:
            raise KeyError(name)
        t = self.tensors[name]
        if t.dtype != dtype or t.shape != shape:
            raise TypeError(f"{name} is {t.dtype}{t.shape}, not {np.dtype(dtype)}{shape}")
        return t


#: A stream of this many bytes or more has its vocabulary in the header.
WITH_VOCABULARY = 10_000


def header_bytes(length: int, coded_: bool, vocabulary: bytes) -> bytes:
    """Five bytes of the length, the top bit telling whether it is coded; from 10,000 bytes on 256 bits of the byte values that occur."""
    out = (length | int(coded_) << 39).to_bytes(5, "big")
    if length >= WITH_VOCABULARY:
        bits = np.zeros(256, np.uint8)
        bits[np.frombuffer(vocabulary, np.uint8)] = 1
        out += np.packbits(bits).tobytes()
    return out


def read_header(raw: bytes) -> tuple[int, bool, np.ndarray, int]:
    """Length, whether it is coded, the byte values that may occur (all in a short stream), bytes read."""
    x = int.from_bytes(raw[:5], "big")
    length, coded_ = x & (1 << 39) - 1, bool(x >> 39)
    if length < WITH_VOCABULARY:
        return length, coded_, np.arange(256), 5
    return length, coded_, np.flatnonzero(np.unpackbits(np.frombuffer(raw[5:37], np.uint8))), 37


#: The header of a stream that is stored as it is.
STORED = bytes(5)


def trailer(sizes: tuple[int, int, int, int]) -> bytes:
    """The four sizes of the parts of an archive, 16 bytes at its end."""
    return struct.pack("<4i", *sizes)


def split_archive(raw: bytes) -> list[bytes]:
    """The four parts of an archive by its trailer."""
    sizes = struct.unpack("<4i", raw[-16:])
    if min(sizes) < 0 or sum(sizes) + 16 != len(raw):
        raise ValueError("the sizes don't fit the archive")
    ends = np.cumsum([0, *sizes]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def require_files(*paths: str) -> None:
    """Fails before any work starts if a local input is missing or a folder."""
    for p in paths:
        if not os.path.isfile(p):
            raise FileNotFoundError(p)
