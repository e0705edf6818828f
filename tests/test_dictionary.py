from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.operators import dictionary as D

WORDS = [b"the", b"and", b"reading", b"nation", b"information", b"x" * 9] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}".encode() for k in range(5000)]


def test_codes_are_prefix_free_and_invert():
    codes = [D.code_of(k) for k in range(44880)]
    assert [D.rank_of(c) for c in codes] == list(range(44880))
    assert sorted({len(c) for c in codes}) == [1, 2, 3]
    have = set(codes)
    assert not any(c[:k] in have for c in codes for k in range(1, len(c)))


@pytest.mark.parametrize("text", ["", "The AND the", "Information INFORMATION misinformation informations iNation", "é ü 漢 \x1b\x1c\x1d\x00", "A b C", "ABCdef XYz", "reading.READING;Reading", "ÀThe", "wabaX" * 9])
def test_round_trip(text):
    d = D.Dictionary(WORDS)
    raw = text.encode()
    assert d.decode(d.encode(raw)) == raw


def test_random_round_trips_and_affixes():
    rng = random.Random(5)
    d = D.Dictionary(WORDS)
    parts = [b"the", b"The", b"THE", b"x", b"X", b"information", b" ", b".", b"\xc3\xa9", b"\x1b", b"\xff", b"waba", b"Readings", b"\xd0\xf0"]
    for _ in range(500):
        raw = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert d.decode(d.encode(raw)) == raw
    assert d.word(b"misinformation") == b"mis" + D.code_of(4) and d.word(b"informations") == D.code_of(4) + b"s"
    assert d.word(b"thenation") == b"thenation"  # affixes have seven letters at least


def walk(raw):
    """The detector, byte by byte."""
    out, start, state, run, blanks, score = [], 0, False, 0, 0, 0
    ok = D.is_text(raw)
    i = 0
    while i < len(raw):
        if not state:
            j, n, b = i, 0, 0
            while j < len(raw) and ok[j]:
                n, b, j = n + 1, b + (raw[j] == 32), j + 1
            if n > D.ENTER and b >= D.LEAST_BLANKS:
                if i > start:
                    out.append((False, start, i))
                start, state, score = i, True, 0
            else:
                i = j + 1
                continue
        score = max(0, score - 1) if ok[i] else score + D.PENALTY
        i += 1
        if score > D.LEAVE:
            out.append((True, start, i))
            start, state = i, False
    if start < len(raw):
        out.append((state, start, len(raw)))
    return out


def test_blocks_equal_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(0, 6)):
            n = int(rng.integers(0, 1200))
            parts.append(bytes(rng.choice([32, 97, 98], n).astype(np.uint8)) if rng.random() < 0.6 else bytes(rng.choice([200, 97, 0], n // 20, p=[0.4, 0.5, 0.1]).astype(np.uint8)))
        raw = b"".join(parts)
        assert D.blocks(raw) == walk(raw)
        d = D.Dictionary(WORDS)
        assert D.decode_blocks(D.encode_blocks(raw, d), d) == raw


def test_tokens_are_worked_out_once_and_kept_within_bounds(monkeypatch):
    monkeypatch.setattr("corpusloom.functions.known.KEPT", 5)
    d = D.Dictionary(WORDS)
    made = []
    find = d.find
    d.find = lambda w: made.append(w) or find(w)
    raw = b"misinformation " * 40 + b"y" * 500 + b" \x1b\n\xff \xd0\xf0"
    assert d.decode(d.encode(raw)) == raw and made.count(b"misinformation") == 1
    raw = b" ".join(WORDS[6:200])
    assert d.decode(d.encode(raw)) == raw and len(d.codes) <= 5 and len(d.texts) <= 5
    code = d.encode(raw)
    d.encode = None  # the whole is one block: its code is known
    assert D.encode_blocks(raw, d, code) == [(7, len(code), code)]
