"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one multiword Shift-And automaton: each glob owns
a run of bits (a start bit and one bit for each character it consumes), and one
step moves every glob of every URL of a batch by one byte:

    D = ((D << 1) & B[c]) | (D & S[c])

``B[c]`` marks the positions that byte c satisfies, ``S[c]`` those at which a
star lets the glob stand still. ``*`` stands for any run without ``/``, ``**``
for any run, ``?`` for one byte. The canonical URL is ``.host/path``.

Defined results: a null URL, or one without ``://``, has an empty host and path
and can match no host rule; ties of equal length go to the earlier rule; extra
columns and repeated rows pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import map_text, slices, text_bytes

URL_RX = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``; or a free ``glob`` over ``.host/path``."""

    host: str = ""
    path: str = ""
    verdict: str = "block"
    glob: str = ""

    @property
    def text(self) -> str:
        return self.glob or self.host + self.path

    @property
    def pattern(self) -> str:
        return self.glob or f"*.{self.host}{self.path}**"


#: The contract's rules, then globs over the host that judge what no rule decides.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
SPAM_GLOBS = tuple(Rule(glob=g) for g in ("*casino*/**", "*-pills.*/**", "*.adult-*/**"))


class ShiftAnd:
    """The automaton of a list of globs."""

    def __init__(self, globs: list[str]) -> None:
        bits = sum(len(self._tokens(g)[0]) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for g in globs:
            tokens, stars = self._tokens(g)
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for k, tok in enumerate(tokens):
                w, b = divmod(at + k + 1, 64)
                self.step[slice(None) if tok is None else tok, w] |= np.uint64(1 << b)
            for k, kind in stars.items():
                w, b = divmod(at + k, 64)
                keep = np.ones(256, bool)
                keep[ord("/")] = kind == 2
                self.stay[keep, w] |= np.uint64(1 << b)
            w, b = divmod(at + len(tokens), 64)
            self.final.append((w, np.uint64(1 << b)))
            at += len(tokens) + 1

    @staticmethod
    def _tokens(glob: str) -> tuple[list[int | None], dict[int, int]]:
        tokens: list[int | None] = []
        stars: dict[int, int] = {}
        for b in glob.encode():
            if b == ord("*"):
                stars[len(tokens)] = min(2, stars.get(len(tokens), 0) + 1)
            else:
                tokens.append(None if b == ord("?") else b)
        return tokens, stars

    def match(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Row x glob: does the glob match the whole string?"""
        n = len(off) - 1
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        starts, size = off[:-1][order], size[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for t in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -t, side="left"))
            c = data[starts[:live] + t]
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.step[c]
            d &= self.stay[c]
            d |= moved
        out = np.zeros((n, len(self.final)), bool)
        for k, (w, bit) in enumerate(self.final):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, globs: tuple[Rule, ...] = SPAM_GLOBS, default: str = "allow") -> DataFrame:
    """Add host, path, rule, verdict and the glob that decided where no rule fits; all other columns stay, those of these names are replaced."""
    first = sorted(range(len(rules)), key=lambda k: -len(rules[k].text))
    ordered = [rules[k] for k in first] + list(globs)
    auto = ShiftAnd([r.pattern for r in ordered])
    n_rules = len(rules)
    new = ("host", "path", "rule", "verdict", "glob")
    cols = [c for c in df.columns if c not in new]
    src = df.select(
        *cols,
        F.translate(F.coalesce(F.regexp_extract(url, URL_RX, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.coalesce(F.regexp_extract(url, URL_RX, 2), F.lit("")).alias("path"),
    )
    schema = T.StructType([*src.schema.fields, *[T.StructField(c, T.StringType()) for c in new[2:]]])
    src = src.withColumn("__canon", F.concat(F.lit("."), F.col("host"), F.col("path")))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(batch.column(batch.num_columns - 1))
        rule, verdict, glob = [], [], []
        for i, j in slices(np.diff(off)):
            hit = auto.match(data[off[i] : off[j]], off[i : j + 1] - off[i])
            best = np.where(hit.any(1), hit.argmax(1), -1)
            rule += [ordered[k].text if 0 <= k < n_rules else None for k in best]
            glob += [ordered[k].text if k >= n_rules else None for k in best]
            verdict += [ordered[k].verdict if k >= 0 else default for k in best]
        out = [batch.column(k) for k in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*out, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(glob, pa.string())], names=[f.name for f in schema.fields])

    return map_text(src, fn, schema)
