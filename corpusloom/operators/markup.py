"""Reversible transforms of markup: entities, permutation, run swap, timestamps, deltas, tail lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.ordered import ordered
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

#: Marks itself, and with a letter a raw character that an entity stands for.
ESC = "\x03"
RAW = (('"', "q", "&quot;"), ("<", "l", "&lt;"), (">", "g", "&gt;"))


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def unescape(c: Column) -> Column:
    """Entities become characters; raw characters become the mark and a letter, so nothing is ambiguous."""
    c = swap(c, (ESC, ESC + "e"), *[(r, ESC + k) for r, k, _ in RAW], *[(e, r) for r, _, e in RAW])
    return swap(c, ("&amp;", ESC + "A"), ("&", ESC + "a"), (ESC + "A", "&"))


def escape(c: Column) -> Column:
    """The inverse of ``unescape``."""
    c = swap(c, ("&", "&amp;"), *[(r, e) for r, _, e in RAW], *[(ESC + k, r) for r, k, _ in RAW])
    return swap(c, (ESC + "a", "&"), (ESC + "e", ESC))


def unescape_sql(x: str) -> str:
    steps = [("chr(3)", "chr(3) || 'e'"), *[(f"'{r}'", f"chr(3) || '{k}'") for r, k, _ in RAW], *[(f"'{e}'", f"'{r}'") for r, _, e in RAW], ("'&amp;'", "chr(3) || 'A'"), ("'&'", "chr(3) || 'a'"), ("chr(3) || 'A'", "'&'")]
    for a, b in steps:
        x = f"replace({x}, {a}, {b})"
    return x


@query("entity_roundtrip", f"SELECT page_id, md5({unescape_sql('html')}) AS coded_md5, CAST(length({unescape_sql('html')}) AS INT) AS coded_length, true AS ok FROM pages")
def entity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("c", unescape(F.col("html")))
    return p.select("page_id", F.md5(F.encode("c", "utf-8")).alias("coded_md5"), F.length("c").alias("coded_length"), (escape(F.col("c")) == F.col("html")).alias("ok"))


# fixed values: the character ranges that change places
FROM, TO = "{|}~PQRS:;<=>?JKLMNOX`", "PQRS{|}~JKLMNO:;<=>?`X"


@query("char_permutation", f"SELECT page_id, md5(translate(html, '{FROM}', '{TO}')) AS coded_md5, translate(translate(html, '{FROM}', '{TO}'), '{FROM}', '{TO}') = html AS self_inverse FROM pages")
def char_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("c", F.translate("html", FROM, TO))
    return p.select("page_id", F.md5(F.encode("c", "utf-8")).alias("coded_md5"), (F.translate("c", FROM, TO) == F.col("html")).alias("self_inverse"))


def swap_runs(c: Column, chars: str = "{}[]&") -> Column:
    """Runs of one and of two of each character change places; other runs stay. Its own inverse."""
    for ch in chars:
        q = "\\" + ch
        c = F.regexp_replace(c, f"(?<!{q}){q}{q}(?!{q})", "\x01")
        c = F.regexp_replace(c, f"(?<!{q}){q}(?!{q})", ch + ch)
        c = F.replace(c, F.lit("\x01"), F.lit(ch))
    return c


@query(
    "run_swap",
    r"""
WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS p FROM pages),
r AS (SELECT *, p - row_number() OVER (PARTITION BY page_id, c ORDER BY p) AS k FROM c),
g AS (SELECT page_id, c, min(p) AS p, count(*) AS n FROM r WHERE c IN ('{', '}', '[', ']', '&') GROUP BY page_id, c, k
      UNION ALL SELECT page_id, c, p, -1 FROM r WHERE c NOT IN ('{', '}', '[', ']', '&'))
SELECT page_id, md5(string_agg(CASE n WHEN -1 THEN c WHEN 1 THEN c || c WHEN 2 THEN c ELSE repeat(c, n) END, '' ORDER BY p)) AS coded_md5, true AS self_inverse FROM g GROUP BY page_id
""",
)
def run_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("c", swap_runs(F.col("html")))
    return p.select("page_id", F.md5(F.encode("c", "utf-8")).alias("coded_md5"), (swap_runs(F.col("c")) == F.col("html")).alias("self_inverse"))


@query(
    "timestamp_code",
    """
WITH c AS (SELECT event_id, ts, CAST(year(ts) - 2001 AS INT) AS y, CAST((month(ts) - 1) * 31 + day(ts) - 1 AS INT) AS d, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS s FROM events)
SELECT event_id, y, d, s, true AS ok FROM c
""",
)
def timestamp_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year - 2001, day in a year of 31-day months, second of the day), and whether it leads back."""
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        (F.year("ts") - 2001).alias("y"),
        ((F.month("ts") - 1) * 31 + F.dayofmonth("ts") - 1).alias("d"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("s"),
    )
    back = F.make_timestamp(F.col("y") + 2001, F.expr("d div 31 + 1").cast("int"), F.expr("d % 31 + 1").cast("int"), F.expr("s div 3600").cast("int"), F.expr("s div 60 % 60").cast("int"), F.expr("s % 60").cast("int"))
    return e.select("event_id", "y", "d", "s", (back == F.date_trunc("second", "ts")).alias("ok"))


@query(
    "id_delta_roundtrip",
    """
WITH d AS (SELECT o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (ORDER BY o_orderkey) AS delta FROM orders)
SELECT o_orderkey, delta, sum(delta) OVER (ORDER BY o_orderkey)::BIGINT = o_orderkey AS ok FROM d
""",
)
def id_delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as differences, and their prefix sums. Both passes run by bucket, none in one task."""
    d = ordered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    d = d.select("o_orderkey", (F.col("o_orderkey") - F.coalesce("prev", F.lit(0))).alias("delta"))
    back = ordered(d, "o_orderkey", add=F.col("delta"))
    return back.select("o_orderkey", "delta", (F.col("before") + F.col("delta") == F.col("o_orderkey")).alias("ok"))


@query(
    "tail_split",
    """
WITH l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM (SELECT row_number() OVER () AS r, * FROM documents)),
k AS (SELECT r, doc_id, p, line, max(CASE WHEN regexp_matches(line, '[.!?]$') THEN 0 ELSE p END) OVER (PARTITION BY r) AS last FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE p > last) AS n_tail FROM k GROUP BY r, doc_id
""",
)
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document, and those of its tail: the longest end in which every line ends a sentence."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")  # a null text counts as empty
    n_tail = F.aggregate(lines, F.lit(0), lambda acc, x: F.when(x.rlike("[.!?]$"), acc + 1).otherwise(F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), n_tail.cast("bigint").alias("n_tail"))
