"""Words: dictionary codes, affixes, stems, word contexts, columns, brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.stemmer import stem
from corpusloom.operators.matching import previous
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

# fixed sizes of the three groups of codes
ONE, TWO, THREE = 80, 3840, 40960
WORDS_SQL = "WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w), r AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) - 1 AS rank FROM w)"


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent words with their ranks; the window runs over these only."""
    top = counts.orderBy(F.desc("n"), "w").limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "w")) - 1)


@query(
    "dictionary_codes",
    WORDS_SQL
    + """ SELECT w AS word, n, CAST(rank AS INT) AS rank, CASE WHEN rank < 80 THEN printf('%02X', 128 + rank)
  WHEN rank < 3920 THEN printf('%02X%02X', 208 + (rank - 80) // 80, 128 + (rank - 80) % 80)
  ELSE printf('%02X%02X%02X', 208 + (rank - 3920) // 1280, 240 + (rank - 3920) // 80 % 16, 128 + (rank - 3920) % 80) END AS code FROM r WHERE rank < 44880""",
)
def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-free codes of one to three bytes by rank: the lead byte tells the length with the second one."""
    r = ranked(word_counts(spark, sf_dir), ONE + TWO + THREE)
    two, three = F.col("rank") - ONE, F.col("rank") - (ONE + TWO)
    code = (
        F.when(F.col("rank") < ONE, F.format_string("%02X", 128 + F.col("rank")))
        .when(F.col("rank") < ONE + TWO, F.format_string("%02X%02X", (208 + F.floor(two / 80)).cast("int"), 128 + two % 80))
        .otherwise(F.format_string("%02X%02X%02X", (208 + F.floor(three / 1280)).cast("int"), (240 + F.floor(three / 80) % 16).cast("int"), 128 + three % 80))
    )
    return r.select(F.col("w").alias("word"), "n", "rank", code.alias("code"))


def affix_sql(size: int) -> str:
    return (
        WORDS_SQL
        + f""", d AS (SELECT w FROM r WHERE rank < {size} AND length(w) >= 7), o AS (SELECT w FROM r WHERE rank >= {size} AND length(w) > 7),
x AS (SELECT o.w, 'suffix' AS kind, k, right(o.w, k) AS affix FROM o, unnest(range(7, length(o.w))) t(k) UNION ALL SELECT o.w, 'prefix', k, left(o.w, k) FROM o, unnest(range(7, length(o.w))) t(k)),
m AS (SELECT x.*, row_number() OVER (PARTITION BY x.w ORDER BY kind DESC, k DESC) AS i FROM x JOIN d ON d.w = x.affix)
SELECT w AS word, kind, affix FROM m WHERE i = 1"""
    )


def affixes(counts: DataFrame, size: int) -> DataFrame:
    """For words outside the ``size`` most frequent ones the longest suffix, else the longest prefix, of 7 letters or more that is among these."""
    top = ranked(counts, size).select("w")
    known = top.filter(F.length("w") >= 7).select(F.col("w").alias("affix"))
    rest = counts.filter(F.length("w") > 7).join(top, "w", "left_anti").select("w", F.explode(F.sequence(F.lit(7), F.length("w") - 1)).alias("k"))
    both = rest.select("w", "k", F.inline(F.array(F.struct(F.lit(1).alias("s"), F.expr("right(w, k)").alias("affix")), F.struct(F.lit(0).alias("s"), F.expr("left(w, k)").alias("affix")))))
    # the dictionary has at most ``size`` rows
    hit = both.join(F.broadcast(known), "affix").groupBy("w").agg(F.max(F.struct("s", "k", "affix")).alias("m"))
    return hit.select(F.col("w").alias("word"), F.when(F.col("m.s") == 1, "suffix").otherwise("prefix").alias("kind"), F.col("m.affix").alias("affix"))


@query("affix_match", affix_sql(ONE + TWO + THREE))
def affix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affixes in the dictionary of all words that have a code."""
    return affixes(word_counts(spark, sf_dir), ONE + TWO + THREE)


@query("stem_types")
def stem_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and word classes of the English words. The function runs once for each distinct word."""

    @F.pandas_udf("stem string, kind string")
    def stems(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stem(x) for x in s], columns=["stem", "kind"])

    words = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("s", stems("word")).select("word", "n", "s.stem", "s.kind")


WORD = re.compile("[a-z]+")


def word_ids(text: str | None) -> np.ndarray:
    """The words of a text, lower-cased, as numbers in order of their first occurrence."""
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in WORD.findall((text or "").lower())], np.int64)


def word_hits(ids: np.ndarray, lags: tuple[int, ...]) -> tuple[int, int]:
    """Predictions of the next word by the last occurrence of the words at these distances, and hits."""
    reach = max(lags)
    if len(ids) <= reach:
        return 0, 0
    key = np.zeros(len(ids) - reach, np.int64)
    size = int(ids.max()) + 1
    for n, k in enumerate(lags):
        if n and size ** (n + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * size + ids[reach - k : len(ids) - k]
    prev = previous(key)
    nxt = ids[reach:]
    at = np.flatnonzero(prev >= 0)
    return len(at), int((nxt[at] == nxt[prev[at]]).sum())


CONTEXTS = {"1": (1,), "2": (2,), "1-2": (1, 2), "1-3": (1, 3), "1-2-3": (1, 2, 3)}


@query(
    "word_context_hits",
    """
WITH t AS (SELECT row_number() OVER () AS doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM t),
l AS (SELECT doc_id, p, w, lag(w, 1) OVER o AS a, lag(w, 2) OVER o AS b, lag(w, 3) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, p, w, '1' AS context, a AS key FROM l UNION ALL SELECT doc_id, p, w, '2', b FROM l UNION ALL SELECT doc_id, p, w, '1-2', a || ' ' || b FROM l
      UNION ALL SELECT doc_id, p, w, '1-3', CASE WHEN c IS NOT NULL THEN a || ' ' || c END FROM l UNION ALL SELECT doc_id, p, w, '1-2-3', a || ' ' || b || ' ' || c FROM l),
g AS (SELECT doc_id, context, w, lag(w) OVER (PARTITION BY doc_id, context, key ORDER BY p) AS guess FROM k WHERE key IS NOT NULL)
SELECT context, count(guess) AS n_predicted, count(*) FILTER (WHERE guess = w) AS n_hit FROM g GROUP BY context HAVING count(guess) > 0
""",
)
def word_context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the last occurrence of a word context within the document predicts the next word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = {c: [0, 0] for c in CONTEXTS}
            for t in batch.column(0).to_pylist():
                ids = word_ids(t)
                for c, lags in CONTEXTS.items():
                    n, hit = word_hits(ids, lags)
                    total[c][0] += n
                    total[c][1] += hit
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in (0, 1))], names=["context", "n", "hit"])

    got = table(spark, sf_dir, "documents").select("text").mapInArrow(run, "context string, n bigint, hit bigint")
    # a context that no word has is no row
    return got.groupBy("context").agg(F.sum("n").alias("n_predicted"), F.sum("hit").alias("n_hit")).filter("n_predicted > 0")


@query(
    "column_above",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
p AS (SELECT r, line, lag(line) OVER (PARTITION BY r ORDER BY i) AS above FROM l),
c AS (SELECT r, substr(line, k, 1) = substr(above, k, 1) AS hit FROM p, unnest(range(1, least(length(line), length(above)) + 1)) t(k) WHERE above IS NOT NULL),
t AS (SELECT r, count(*) AS n_known, count(*) FILTER (WHERE hit) AS n_hit FROM c GROUP BY r)
SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(n_hit, 0) AS n_hit FROM d LEFT JOIN t USING (r)
""",
)
def column_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that have one above them in the line before, and those equal to it."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    pairs = F.transform(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), lambda x, i: F.struct(F.get(lines, i).alias("a"), x.alias("b")))
    n = F.transform("p", lambda x: F.least(F.length(x.a), F.length(x.b)))
    same = F.transform("p", lambda x: F.size(F.filter(F.zip_with(F.split(x.a, ""), F.split(x.b, ""), lambda u, v: (u != "") & u.eqNullSafe(v)), lambda z: z)))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table(spark, sf_dir, "documents").select("doc_id", pairs.alias("p")).select("doc_id", add(n).alias("n_known"), add(same).alias("n_hit"))


@query(
    "bracket_depth",
    """
WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS p FROM pages),
d AS (SELECT page_id, sum(CASE WHEN c IN ('<', '(', '[', '{') THEN 1 WHEN c IN ('>', ')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY p) AS depth FROM c)
SELECT page_id, CAST(max(depth) AS INT) AS deepest, CAST(min(depth) AS INT) AS lowest FROM d GROUP BY page_id
""",
)
def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest and the lowest level of nesting of a page's brackets, folded over the brackets alone."""
    marks = F.filter(F.split(F.regexp_replace("html", r"[^<>()\[\]{}]", ""), ""), lambda x: x != "")
    step = F.transform(marks, lambda x: F.when(x.isin("<", "(", "[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("d"), F.lit(-(1 << 30)).alias("hi"), F.lit(1 << 30).alias("lo"))
    fold = F.aggregate(step, start, lambda a, x: F.struct((a.d + x).alias("d"), F.greatest(a.hi, a.d + x).alias("hi"), F.least(a.lo, a.d + x).alias("lo")))
    # a character before the first bracket has depth 0
    plain = F.when(F.substring("html", 1, 1).rlike(r"[<>()\[\]{}]"), F.lit(None)).otherwise(0)
    return table(spark, sf_dir, "pages").select("page_id", fold.alias("f"), plain.alias("z")).select("page_id", F.greatest("f.hi", "z").alias("deepest"), F.least("f.lo", "z").alias("lowest"))
