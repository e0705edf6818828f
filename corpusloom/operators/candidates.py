"""Candidates of the past: longest of several lengths, matches that recover, closing brackets, bit nodes.

Defined results: a null or empty text has no positions; rows that are alike count each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.operators.contexts import Features
from corpusloom.operators.matching import gram_ids, previous
from corpusloom.operators.symbols import code_points
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

LENGTHS = (9, 7, 5, 3)
CH_SQL = "WITH t AS (SELECT row_number() OVER () AS id, text FROM {t} WHERE text <> ''), ch AS (SELECT id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM t), x AS (SELECT * FROM ch WHERE c <> '')"


def counted(docs: DataFrame, column: str, fn: Callable[[str], dict], names: list[str]) -> DataFrame:
    """Sums over all texts of the counts that ``fn`` gives by key; keys are tuples of as many numbers as there are names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, int] = {}
            for t in batch.column(0).to_pylist():
                for k, n in fn(t).items():
                    total[k] = total.get(k, 0) + n
            cols = [pa.array([int(k[j]) for k in total], pa.int32()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(total.values()), pa.int64())], names=[*names, "n"])

    src = docs.select(column).filter(F.col(column) != "")
    got = src.mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", n bigint")
    return got.groupBy(*names).agg(F.sum("n").alias("n"))


def longest_candidate(text: str) -> dict[tuple, int]:
    """Of each place the longest length whose gram occurred before (0 without), and whether what followed then comes again."""
    cp = code_points(text).astype(np.int64)
    length, hit = np.zeros(len(cp), int), np.zeros(len(cp), int)
    for k in reversed(LENGTHS):
        if len(cp) > k:
            prev = previous(gram_ids(cp, k)[:-1])
            at = np.flatnonzero(prev >= 0)
            length[at + k] = k
            hit[at + k] = cp[at + k] == cp[prev[at] + k]
    keys, n = np.unique(np.stack([length, hit], 1), axis=0, return_counts=True)
    return {tuple(k): int(c) for k, c in zip(keys.tolist(), n, strict=True)}


@query(
    "longest_candidates",
    CH_SQL.format(t="conversations")
    + ", "
    + ", ".join(f"g{k} AS (SELECT id, p, CASE WHEN p > {k} THEN lag(c) OVER (PARTITION BY id, CASE WHEN p > {k} THEN substr(text, p - {k}, {k}) END ORDER BY p) END AS s FROM x)" for k in LENGTHS)
    + " SELECT CAST(CASE "
    + " ".join(f"WHEN g{k}.s IS NOT NULL THEN {k}" for k in LENGTHS)
    + " ELSE 0 END AS INT) AS length, CAST(coalesce(CASE "
    + " ".join(f"WHEN g{k}.s IS NOT NULL THEN CAST(g{k}.s = c AS INT)" for k in LENGTHS)
    + " END, 0) AS INT) AS hit, count(*) AS n FROM x "
    + " ".join(f"JOIN g{k} USING (id, p)" for k in LENGTHS)
    + " GROUP BY ALL",
)
def longest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the turns by the longest of four candidate lengths, and whether its prediction is right."""
    return counted(table(spark, sf_dir, "conversations"), "text", longest_candidate, ["length", "hit"])


def recovering(text: str, k: int = 5) -> dict[tuple, int]:
    """Runs of matches at one distance that go on over a gap of one place, by length (at most 31)."""
    cp = code_points(text).astype(np.int64)
    if len(cp) < k:
        return {}
    prev = previous(gram_ids(cp, k))
    at = np.flatnonzero(prev >= 0)
    off = at - prev[at]
    order = np.lexsort((at, off))
    at, off = at[order], off[order]
    new = np.ones(len(at), bool)
    new[1:] = (off[1:] != off[:-1]) | (at[1:] - at[:-1] > 2)
    n = np.minimum(31, np.diff(np.append(np.flatnonzero(new), len(at))))
    return {(int(x),): int(c) for x, c in zip(*np.unique(n, return_counts=True), strict=True)}


@query(
    "recovering_matches",
    CH_SQL.format(t="conversations")
    + """, m AS (SELECT id, p, p - lag(p) OVER (PARTITION BY id, substr(text, p, 5) ORDER BY p) AS o FROM x WHERE p + 4 <= length(text)),
g AS (SELECT id, o, p, CASE WHEN p - lag(p) OVER (PARTITION BY id, o ORDER BY p) <= 2 THEN 0 ELSE 1 END AS new FROM m WHERE o IS NOT NULL),
r AS (SELECT id, o, sum(new) OVER (PARTITION BY id, o ORDER BY p) AS k FROM g), l AS (SELECT least(31, count(*)) AS length FROM r GROUP BY id, o, k)
SELECT CAST(length AS INT) AS length, count(*) AS n FROM l GROUP BY length""",
)
def recovering_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of five characters that survive one mismatch, by the places they cover."""
    return counted(table(spark, sf_dir, "conversations"), "text", recovering, ["length"])


def closings(text: str) -> dict[tuple, int]:
    """At each place within brackets: the open bracket's code point, the distance to it (at most 20), whether a closing one comes."""
    f = Features(text)
    inner = f.nesting()[1]
    at = np.flatnonzero(inner >= 0)
    close = np.isin(f.cp[at], [ord(c) for c in ">)]}"])
    keys, n = np.unique(np.stack([f.cp[inner[at]], np.minimum(20, at - inner[at]), close], 1), axis=0, return_counts=True)
    return {tuple(k): int(c) for k, c in zip(keys.tolist(), n, strict=True)}


@query(
    "closing_brackets",
    """
WITH t AS (SELECT row_number() OVER () AS id, html AS text FROM pages WHERE html <> ''), ch AS (SELECT id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM t),
d AS (SELECT *, CASE WHEN c IN ('<', '(', '[', '{') THEN 1 WHEN c IN ('>', ')', ']', '}') THEN -1 ELSE 0 END AS d FROM ch WHERE c <> ''),
b AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM d),
i AS (SELECT id, p, max(CASE WHEN opener THEN p END) OVER (PARTITION BY id, level ORDER BY p, opener ROWS UNBOUNDED PRECEDING) AS io, opener FROM (SELECT id, p, depth AS level, false AS opener FROM b UNION ALL SELECT id, p, depth + 1, true FROM b WHERE d = 1)),
k AS (SELECT unicode(substr(text, CAST(io AS BIGINT), 1)) AS bracket, least(20, b.p - io) AS distance, CAST(d = -1 AS INT) AS closes FROM b JOIN i ON i.id = b.id AND i.p = b.p AND NOT i.opener WHERE io IS NOT NULL)
SELECT CAST(bracket AS INT) AS bracket, CAST(distance AS INT) AS distance, closes, count(*) AS n FROM k GROUP BY ALL
""",
)
def closing_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a closing bracket comes, by the open one and the distance to it."""
    return counted(table(spark, sf_dir, "pages"), "html", closings, ["bracket", "distance", "closes"])


@query(
    "bit_node_bits",
    """
WITH t AS (SELECT row_number() OVER () AS id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM benchmark), ch AS (SELECT id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM t),
x AS (SELECT unicode(c) AS b, coalesce(unicode(lag(c) OVER (PARTITION BY id ORDER BY p)), 0) AS ctx FROM ch WHERE c <> ''),
n AS (SELECT k, ctx, (1 << CAST(k AS INT)) + (b >> CAST(8 - k AS INT)) AS node, (b >> CAST(7 - k AS INT)) & 1 AS bit FROM x, range(8) r(k)),
g AS (SELECT k, ctx, node, count(*) FILTER (WHERE bit = 0) AS a, count(*) FILTER (WHERE bit = 1) AS b FROM n GROUP BY ALL)
SELECT CAST(k AS INT) AS depth, count(*) AS n_nodes, round(sum(lgamma(a + b + 2) - lgamma(a + 1) - lgamma(b + 1)) / ln(2), 3) AS bits FROM g GROUP BY k
""",
)
def bit_node_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive code length of the bits of ASCII text by (byte before, bits so far), for each depth in the byte. Only counted pairs of bytes are taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(1 << 16, np.int64)
            for t in batch.column(0).to_pylist():
                b = np.array([c for c in (t or "").encode("utf-8", "surrogatepass") if c < 128], np.int64)
                total += np.bincount(np.concatenate([[0], b[:-1]])[: len(b)] * 256 + b, minlength=1 << 16)
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((k >> 8).astype(np.int32)), pa.array((k & 255).astype(np.int32)), pa.array(total[k])], names=["ctx", "b", "n"])

    pairs = table(spark, sf_dir, "benchmark").select("text").mapInArrow(run, "ctx int, b int, n bigint").groupBy("ctx", "b").agg(F.sum("n").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("depth")
    n = pairs.select("ctx", "b", "n", k).select("depth", "ctx", F.expr("shiftleft(1, depth) + shiftright(b, 8 - depth)").alias("node"), F.expr("shiftright(b, 7 - depth) & 1").alias("bit"), "n")
    g = n.groupBy("depth", "ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("b"))

    cost = N.log2_factorial(F.col("a") + F.col("b") + 1) - N.log2_factorial(F.col("a")) - N.log2_factorial(F.col("b"))
    return g.groupBy("depth").agg(F.count("*").alias("n_nodes"), F.round(F.sum(cost), 3).alias("bits"))


@query("logarithm_table", "SELECT CAST(x AS INT) AS x, CAST(round_even(16 * log2(x), 0) AS INT) AS steps FROM range(1, 4096) t(x)")
def logarithm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of base 2 in sixteenths."""
    x = F.col("id").cast("int")
    return spark.range(1, 4096).select(x.alias("x"), F.rint(16 * F.log2(x)).cast("int").alias("steps"))
