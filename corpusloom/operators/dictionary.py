"""The dictionary transform of texts and its inverse, blocks, and a model primed by the dictionary.

A text is a row of tokens: words (lower case, one capital first, or capitals alone) and
single bytes. A word is coded as a flag for its case and then its code, or the letters
around the code of its longest suffix, else prefix, that the dictionary has, or its
letters alone. Bytes that mean something else in the code are escaped. All work is per
document; the dictionary has at most 44,880 rows, which are broadcast.

Defined results: a null text counts as empty; every text comes back byte for byte; rows
that are alike get a row each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.known import Known
from corpusloom.operators.symbols import char_counts
from corpusloom.operators.words import ONE, THREE, TWO, WORDS_SQL, affixes, ranked, word_counts
from corpusloom.plans.registry import query
from corpusloom.sources.tables import dealt, table

#: Least letters of an affix.
AFFIX = 7
ESCAPE, CAPITAL, CAPITALS = 0x1B, 0x1C, 0x1D
TOKEN = re.compile(rb"[A-Z]?[a-z]+|[A-Z]{2,}(?![a-z])|[^A-Za-z]|[A-Z]")
CODED = re.compile(rb"\x1b(.)|([\x1c\x1d]?)((?:[a-z]|[\x80-\xcf]|[\xd0-\xff][\x80-\xcf]|[\xd0-\xff][\xf0-\xff][\x80-\xcf])+)|(.)", re.S)
#: Whole tokens of a code, without groups.
CODED_TOKEN = re.compile(rb"\x1b.|[\x1c\x1d]?(?:[a-z]|[\x80-\xcf]|[\xd0-\xff][\x80-\xcf]|[\xd0-\xff][\xf0-\xff][\x80-\xcf])+|.", re.S)
PART = re.compile(rb"[a-z]+|[\x80-\xcf]|[\xd0-\xff][\x80-\xcf]|[\xd0-\xff][\xf0-\xff][\x80-\xcf]")


def code_of(rank: int) -> bytes:
    """Prefix-free: 80 codes of one byte, 3840 of two, 40960 of three."""
    if rank < ONE:
        return bytes([0x80 + rank])
    if rank < ONE + TWO:
        a, b = divmod(rank - ONE, 80)
        return bytes([0xD0 + a, 0x80 + b])
    a, b = divmod(rank - ONE - TWO, 80)
    return bytes([0xD0 + a // 16, 0xF0 + a % 16, 0x80 + b])


def rank_of(code: bytes) -> int:
    if len(code) == 1:
        return code[0] - 0x80
    if len(code) == 2:
        return ONE + 80 * (code[0] - 0xD0) + code[1] - 0x80
    return ONE + TWO + 80 * (16 * (code[0] - 0xD0) + code[1] - 0xF0) + code[2] - 0x80


@dataclass
class Dictionary:
    """Words by rank."""

    words: list[bytes]
    rank: dict[bytes, int] = field(default_factory=dict)
    coded: dict[bytes, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rank = {w: k for k, w in enumerate(self.words)}
        self.codes, self.texts = Known(self.encode_token), Known(self.decode_token)

    def word(self, w: bytes) -> bytes:
        """The code of a lower-case word."""
        out = self.coded.get(w)
        if out is None:
            out = self.find(w)
            if len(self.coded) < 1 << 18:
                self.coded[w] = out
        return out

    def find(self, w: bytes) -> bytes:
        if w in self.rank:
            return code_of(self.rank[w])
        for k in range(len(w) - 1, AFFIX - 1, -1):
            if w[-k:] in self.rank:
                return w[:-k] + code_of(self.rank[w[-k:]])
        for k in range(len(w) - 1, AFFIX - 1, -1):
            if w[:k] in self.rank:
                return code_of(self.rank[w[:k]]) + w[k:]
        return w

    def encode_token(self, t: bytes) -> bytes:
        first = t[0]
        if 97 <= first <= 122:
            return self.word(t)
        if len(t) > 1:
            return bytes([CAPITAL if 97 <= t[1] <= 122 else CAPITALS]) + self.word(t.lower())
        return bytes([ESCAPE, first]) if first >= 0x80 or first in (ESCAPE, CAPITAL, CAPITALS) else t

    def decode_token(self, t: bytes) -> bytes:
        escaped, flag, word, plain = CODED.match(t).groups()
        if not word:
            return escaped or plain
        w = b"".join(p if p[0] < 0x80 else self.words[rank_of(p)] for p in PART.findall(word))
        return w if not flag else w.upper() if flag[0] == CAPITALS else w[:1].upper() + w[1:]

    def encode(self, raw: bytes) -> bytes:
        return b"".join(map(self.codes.__getitem__, TOKEN.findall(raw)))

    def decode(self, code: bytes) -> bytes:
        return b"".join(map(self.texts.__getitem__, CODED_TOKEN.findall(code)))


def is_text(raw: bytes) -> np.ndarray:
    """Bytes 9 to 13 and 32 to 126."""
    b = np.frombuffer(raw, np.uint8)
    return ((b >= 9) & (b <= 13)) | ((b >= 32) & (b <= 126))


#: A text block begins with more than ENTER text bytes in a row, of which LEAST_BLANKS are blanks; it ends when other bytes, at PENALTY each and forgotten by one a text byte, exceed LEAVE.
ENTER, LEAST_BLANKS, PENALTY, LEAVE = 500, 5, 100, 300


def blocks(raw: bytes) -> list[tuple[bool, int, int]]:
    """(text block, start, end) in order. Only runs and the bytes that aren't text are walked, not every byte."""
    ok = is_text(raw)
    n = len(raw)
    other = np.flatnonzero(~ok)
    edges = np.concatenate([[-1], other, [n]])
    blanks = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) == 32)])
    out: list[tuple[bool, int, int]] = []
    at = 0
    while at < n:
        # the first run of text that is long enough, from here on
        k = int(np.searchsorted(edges, at, side="left"))
        begin = None
        for a, b in zip(edges[max(0, k - 1) : -1].tolist(), edges[max(1, k) :].tolist(), strict=True):
            a = max(a + 1, at)
            if b - a > ENTER and blanks[b] - blanks[a] >= LEAST_BLANKS:
                begin = a
                break
        if begin is None:
            out.append((False, at, n))
            break
        if begin > at:
            out.append((False, at, begin))
        score, last, end = 0, begin, n
        for x in other[np.searchsorted(other, begin) :].tolist():
            score = max(0, score - (x - last)) + PENALTY
            last = x + 1
            if score > LEAVE:
                end = x + 1
                break
        out.append((True, begin, end))
        at = end
    return out


#: Bytes that the transform must save to be kept.
SAVES = 50


def encode_blocks(raw: bytes, d: Dictionary, known: bytes | None = None) -> list[tuple[int, int, bytes]]:
    """``known``: the code of the whole, where it's there. (kind, length of the payload, payload): 7 for a text block by the dictionary, 1 for one as it is, 0 for other bytes. A segment of over 95 % text is one block."""
    parts = blocks(raw)
    text = sum(b - a for t, a, b in parts if t)
    if raw and text > 0.95 * len(raw):
        parts = [(True, 0, len(raw))]
    out = []
    for t, a, b in parts:
        plain = raw[a:b]
        coded = plain if not t else known if known is not None and b - a == len(raw) else d.encode(plain)
        kind = 0 if not t else 7 if len(coded) <= len(plain) - SAVES else 1
        out.append((kind, len(coded) if kind == 7 else len(plain), coded if kind == 7 else plain))
    return out


def decode_blocks(parts: list[tuple[int, int, bytes]], d: Dictionary) -> bytes:
    return b"".join(d.decode(p[:n]) if kind == 7 else p[:n] for kind, n, p in parts)


def shared_dictionary(spark: SparkSession, sf_dir: str) -> Broadcast:
    rows = ranked(word_counts(spark, sf_dir), ONE + TWO + THREE).select("rank", "w").collect()  # at most 44,880
    return spark.sparkContext.broadcast([r.w.encode() for r in sorted(rows, key=lambda r: r.rank)])


@query("dictionary_roundtrip", "SELECT doc_id, strlen(coalesce(text, '')) AS raw_bytes, true AS ok, true AS blocks_ok FROM documents")
def dictionary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is coded and decoded, as a whole and block by block: does it come back?"""
    known = shared_dictionary(spark, sf_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Dictionary(known.value)
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            ok, whole = [], []
            for x in raw:
                code = d.encode(x)
                back = d.decode(code)
                parts = encode_blocks(x, d, code)
                ok.append(back == x)
                # a text that is one block has the code that was just decoded
                whole.append((back if len(parts) == 1 and parts[0] == (7, len(code), code) else decode_blocks(parts, d)) == x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(ok), pa.array(whole)], names=["doc_id", "raw_bytes", "ok", "blocks_ok"])

    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id bigint, raw_bytes bigint, ok boolean, blocks_ok boolean")


@query("dictionary_blocks")
def dictionary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document: kind, start, bytes before and after the transform."""
    known = shared_dictionary(spark, sf_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Dictionary(known.value)
        for batch in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (kind, n, _) in enumerate(encode_blocks((t or "").encode("utf-8", "surrogatepass"), d)):
                    rows.append((i, k, kind, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "block", "kind", "n_bytes"])

    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id bigint, block int, kind int, n_bytes bigint")


SIZE_SQL = "CASE WHEN rank < 80 THEN 1 WHEN rank < 3920 THEN 2 ELSE 3 END"


@query(
    "dictionary_coded_sizes",
    WORDS_SQL
    + f""", d AS (SELECT w, {SIZE_SQL} AS size FROM r WHERE rank < 44880), o AS (SELECT w, n FROM r WHERE rank >= 44880),
x AS (SELECT o.w, 'suffix' AS kind, k, right(o.w, k) AS affix FROM o, unnest(range(7, length(o.w))) t(k) UNION ALL SELECT o.w, 'prefix', k, left(o.w, k) FROM o, unnest(range(7, length(o.w))) t(k)),
m AS (SELECT x.w, x.kind, length(x.w) - k + d.size AS size, row_number() OVER (PARTITION BY x.w ORDER BY kind DESC, k DESC) AS i FROM x JOIN d ON d.w = x.affix),
a AS (SELECT 'exact' AS kind, n, {SIZE_SQL} AS size FROM r WHERE rank < 44880 UNION ALL SELECT coalesce(m.kind, 'letters'), o.n, coalesce(m.size, length(o.w)) FROM o LEFT JOIN m ON m.w = o.w AND m.i = 1)
SELECT kind, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n * size) AS BIGINT) AS n_bytes FROM a GROUP BY kind""",
)
def dictionary_coded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the lower-cased words are coded, and in how many bytes. The affix table serves the words without a code; sizes follow from ranks."""
    counts = word_counts(spark, sf_dir)
    size = lambda rank: F.when(rank < ONE, 1).when(rank < ONE + TWO, 2).otherwise(3)
    top = ranked(counts, ONE + TWO + THREE).select("w", "n", size(F.col("rank")).alias("size"))
    rest = counts.join(top.select("w"), "w", "left_anti")
    by_affix = affixes(counts, ONE + TWO + THREE).join(F.broadcast(top.select(F.col("w").alias("affix"), "size")), "affix")  # 44,880 rows at most
    by_affix = by_affix.select(F.col("word").alias("w"), "kind", (F.length("word") - F.length("affix") + F.col("size")).alias("size"))
    rest = rest.join(by_affix, "w", "left").select(F.coalesce("kind", F.lit("letters")).alias("kind"), "n", F.coalesce("size", F.length("w")).alias("size"))
    both = top.select(F.lit("exact").alias("kind"), "n", "size").unionByName(rest)
    return both.groupBy("kind").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("size")).alias("n_bytes"))


def decoded_rank(code: Column) -> Column:
    """The rank that a code in hexadecimal digits stands for."""
    byte = lambda k: F.conv(F.substr(code, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")
    return (
        F.when(F.length(code) == 2, byte(0) - 128)
        .when(F.length(code) == 4, ONE + 80 * (byte(0) - 208) + byte(1) - 128)
        .otherwise(ONE + TWO + 80 * (16 * (byte(0) - 208) + byte(1) - 240) + byte(2) - 128)
    )


@query("codeword_ranks", WORDS_SQL + " SELECT w AS word, CAST(rank AS INT) AS rank FROM r WHERE rank < 44880")
def codeword_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by decoding the codes of ``dictionary_codes``."""
    from corpusloom.operators.words import dictionary_codes

    return dictionary_codes(spark, sf_dir).select("word", decoded_rank(F.col("code")).alias("rank"))


@query(
    "primed_order0_bits",
    WORDS_SQL
    + """, a AS (SELECT unnest(string_split(w || ' ', '')) AS c FROM r WHERE rank < 44880), p AS (SELECT c, count(*) AS a FROM a WHERE c <> '' GROUP BY c),
b AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT lang, c, count(*) AS n FROM b WHERE c <> '' GROUP BY ALL),
s AS (SELECT DISTINCT c FROM (SELECT c FROM n UNION ALL SELECT c FROM p)), z AS (SELECT s.c, 1 + coalesce(p.a, 0) AS a FROM s LEFT JOIN p USING (c)), t AS (SELECT sum(a) AS t FROM z),
g AS (SELECT lang, sum(n) AS n, sum(lgamma(z.a + n) - lgamma(z.a)) AS own FROM n JOIN z USING (c) GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round((lgamma(t + n) - lgamma(t) - own) / ln(2) / n, 6) AS bits_per_char FROM g, t""",
)
def primed_order0_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a character of an adaptive order-0 model that has read the dictionary (words and blanks) before: its counts are the prior."""
    top = ranked(word_counts(spark, sf_dir), ONE + TWO + THREE).select(F.concat("w", F.lit(" ")).alias("text"))
    prior = char_counts(top).withColumnRenamed("n", "a")
    n = char_counts(table(spark, sf_dir, "documents"), "lang")
    alphabet = n.select("c").union(prior.select("c")).distinct().join(prior, "c", "left").select("c", (1 + F.coalesce("a", F.lit(0))).alias("a"))

    @F.pandas_udf("double")
    def log_gamma(s: pd.Series) -> pd.Series:
        return s.map(math.lgamma)

    total = alphabet.agg(F.sum("a").alias("t"))  # one row
    own = log_gamma((F.col("a") + F.col("n")).cast("double")) - log_gamma(F.col("a").cast("double"))
    g = n.join(alphabet, "c").groupBy("lang").agg(F.sum("n").alias("n"), F.sum(own).alias("own")).crossJoin(total)
    bits = log_gamma((F.col("t") + F.col("n")).cast("double")) - log_gamma(F.col("t").cast("double")) - F.col("own")
    return g.select("lang", "n", F.round(bits / F.ln(F.lit(2.0)) / F.col("n"), 6).alias("bits_per_char"))
