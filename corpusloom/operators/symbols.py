"""Symbol counts: vocabulary, histograms, entropies, adaptive code lengths, classes, line distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


def char_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(by, c, n): counts of characters with map-side combine."""
    chars = docs.select(*by, F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("c")).filter("c <> ''")
    return chars.groupBy(*by, "c").agg(F.count("*").alias("n"))


def bytes_of(counts: DataFrame, *by: str) -> DataFrame:
    """Character counts as byte counts: only distinct characters are taken apart."""
    h = counts.withColumn("h", F.hex(F.encode("c", "utf-8")))
    one = h.select(*by, "n", F.explode(F.sequence(F.lit(1), F.length("h"), F.lit(2))).alias("i"), "h")
    byte = F.conv(F.substr("h", F.col("i"), F.lit(2)), 16, 10).cast("int")
    return one.withColumn("byte", byte).groupBy(*by, "byte").agg(F.sum("n").alias("n"))


@query(
    "char_vocab_by_lang",
    """
WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS c FROM documents),
k AS (SELECT lang, c, hex(encode(c)) AS h FROM c WHERE c <> ''),
b AS (SELECT DISTINCT lang, substr(h, CAST(i AS INT), 2) AS b FROM k, unnest(range(1, length(h), 2)) t(i))
SELECT lang, (SELECT count(*) FROM k WHERE k.lang IS NOT DISTINCT FROM l.lang) AS n_chars,
       (SELECT count(*) FROM b WHERE b.lang IS NOT DISTINCT FROM l.lang) AS n_bytes
FROM (SELECT DISTINCT lang FROM k) l
""",
)
def char_vocab_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct characters and bytes of each language. Each document gives its distinct characters only."""
    docs = table(spark, sf_dir, "documents")
    chars = docs.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter("c <> ''").distinct()
    per_char = chars.groupBy("lang").agg(F.count("*").alias("n_chars"))
    per_byte = bytes_of(chars.withColumn("n", F.lit(1)), "lang").groupBy("lang").agg(F.count("*").alias("n_bytes"))
    return per_char.join(per_byte, F.expr("true") & per_char.lang.eqNullSafe(per_byte.lang)).select(per_char.lang, "n_chars", "n_bytes")


@query(
    "byte_histogram",
    """
WITH b AS (SELECT unnest(string_split(text, '')) AS c FROM documents),
n AS (SELECT c, count(*) AS n FROM b WHERE c <> '' GROUP BY c),
h AS (SELECT n, hex(encode(c)) AS h FROM n)
SELECT CAST('0x' || substr(h, CAST(i AS INT), 2) AS INT) AS byte, CAST(sum(n) AS BIGINT) AS n FROM h, unnest(range(1, length(h), 2)) t(i) GROUP BY 1
""",
)
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the bytes of all texts."""
    return bytes_of(char_counts(table(spark, sf_dir, "documents")))


@query(
    "absent_bytes",
    """
WITH b AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents),
h AS (SELECT hex(encode(c)) AS h FROM b WHERE c <> ''),
p AS (SELECT DISTINCT CAST('0x' || substr(h, CAST(i AS INT), 2) AS INT) AS byte FROM h, unnest(range(1, length(h), 2)) t(i))
SELECT CAST(r AS INT) AS byte FROM range(256) x(r) WHERE r NOT IN (SELECT byte FROM p)
""",
)
def absent_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte values that no text has."""
    have = bytes_of(char_counts(table(spark, sf_dir, "documents")))
    return spark.range(256).select(F.col("id").cast("int").alias("byte")).join(have, "byte", "left_anti")


@query(
    "vocab_index",
    """
WITH b AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents)
SELECT c AS sym, unicode(c) AS code_point, strlen(c) AS n_bytes, CAST(dense_rank() OVER (ORDER BY unicode(c)) - 1 AS INT) AS idx FROM b WHERE c <> ''
""",
)
def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of the symbols in ascending order. The window runs over the alphabet, which Unicode bounds."""
    from pyspark.sql import Window

    chars = char_counts(table(spark, sf_dir, "documents")).select(F.col("c").alias("sym"), F.ascii("c").alias("code_point"), F.octet_length("c").alias("n_bytes"))
    return chars.withColumn("idx", F.dense_rank().over(Window.orderBy("code_point")) - 1)


@query(
    "order0_entropy_by_lang",
    """
WITH b AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents),
n AS (SELECT lang, c, count(*) AS n FROM b WHERE c <> '' GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM n)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(sum(-(n / t) * log2(n / t)), 6) AS entropy FROM t GROUP BY lang
""",
)
def order0_entropy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the characters, from counts: log2 N - sum(n log2 n) / N."""
    n = char_counts(table(spark, sf_dir, "documents"), "lang").groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return n.select("lang", "n", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def log2_factorials(n: int) -> np.ndarray:
    """log2 k! for k below n."""
    return np.concatenate([[0.0], np.cumsum(np.log2(np.arange(1, max(2, n))))])


def order_k_bits(cp: np.ndarray, k: int, alphabet: int = 256) -> float:
    """Bits of an adaptive order-k model with add-one counts, in closed form from counts."""
    n = len(cp)
    if not n:
        return 0.0
    ctx = np.zeros(n, np.int64)
    for j in range(1, k + 1):
        past = np.concatenate([np.full(min(j, n), -1, np.int64), cp[: max(0, n - j)].astype(np.int64)])[:n]
        ctx = np.unique(ctx * (1 << 22) + past + 1, return_inverse=True)[1].astype(np.int64)
    pair = np.unique(ctx * (1 << 21) + cp, return_counts=True)[1]
    per_ctx = np.unique(ctx, return_counts=True)[1]
    f = log2_factorials(int(per_ctx.max()) + alphabet + 1)
    return float((f[per_ctx + alphabet - 1] - f[alphabet - 1]).sum() - f[pair].sum())


@query(
    "adaptive_order1_bits",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), ch AS (SELECT r, c, p FROM (SELECT r, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM d) WHERE c <> ''),
x AS (SELECT r, c, lag(c, 1, '') OVER (PARTITION BY r ORDER BY p) AS ctx FROM ch),
n AS (SELECT r, ctx, c, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT r, ctx, lgamma(256 + sum(n)) - lgamma(256) - sum(lgamma(1 + n)) AS nats FROM n GROUP BY ALL)
SELECT d.doc_id, length(d.text) AS n_chars, round(coalesce(sum(nats), 0) / ln(2), 3) AS bits FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id, d.text
""",
)
def adaptive_order1_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that an online order-1 model (add-one counts, 256 symbols) needs for each document.

    The total doesn't depend on the order of the symbols, so each document is counted
    where it lies; nothing is exploded or shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [round(order_k_bits(code_points(t or ""), 1), 3) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.float64())], names=["doc_id", "n_chars", "bits"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_chars bigint, bits double")


@query(
    "bytes_since_newline",
    """
WITH ch AS (SELECT doc_id, c, p FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents) WHERE c <> ''),
l AS (SELECT p - coalesce(max(CASE WHEN c = chr(10) THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM ch)
SELECT CAST(least(99, d) AS INT) AS distance, count(*) AS n FROM l GROUP BY 1
""",
)
def bytes_since_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions lie 1, 2, ... 98, at least 99 characters behind a line feed (or the start).

    A line of n characters (with its feed) has one position at each distance up to n,
    so counts of line lengths are enough.
    """
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.length(s) + F.when(i < F.size(F.split("text", "\n")) - 1, 1).otherwise(0))
    n = table(spark, sf_dir, "documents").select(F.explode(lines).alias("len")).groupBy("len").agg(F.count("*").alias("k")).filter("len > 0")
    each = n.select("k", "len", F.explode(F.sequence(F.lit(1), F.least(F.lit(99), "len"))).alias("distance"))
    return each.groupBy("distance").agg(F.sum(F.when(F.col("distance") == 99, F.col("k") * (F.col("len") - 98)).otherwise(F.col("k"))).cast("bigint").alias("n"))


#: Classes of characters: lower, upper, digit, blank, mark, other.
CLASSES = "aA9_.x"


def class_of(cp: np.ndarray) -> np.ndarray:
    """The class of each code point, by a table of the ASCII ones."""
    return CLASS_TABLE[np.minimum(cp, 128)]


def class_table() -> np.ndarray:
    c = np.arange(129)
    ranges = [(c >= 97) & (c <= 122), (c >= 65) & (c <= 90), (c >= 48) & (c <= 57), np.isin(c, (9, 10, 13, 32)), (c > 32) & (c < 127)]
    return np.select(ranges, range(5), 5).astype(np.int8)


CLASS_TABLE = class_table()


@query(
    "byte_class_stream",
    r"""
WITH ch AS (SELECT doc_id, lang, c, p FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM (SELECT row_number() OVER () AS doc_id, lang, text FROM documents)) WHERE c <> ''),
k AS (SELECT *, CASE WHEN c BETWEEN 'a' AND 'z' THEN 'a' WHEN c BETWEEN 'A' AND 'Z' THEN 'A' WHEN c BETWEEN '0' AND '9' THEN '9'
      WHEN c IN (' ', chr(9), chr(10), chr(13)) THEN '_' WHEN unicode(c) BETWEEN 33 AND 126 THEN '.' ELSE 'x' END AS cls FROM ch),
r AS (SELECT lang, cls, cls IS DISTINCT FROM lag(cls) OVER (PARTITION BY doc_id ORDER BY p) AS new FROM k)
SELECT lang, cls, count(*) AS n_chars, count(*) FILTER (WHERE new) AS n_runs FROM r GROUP BY ALL
""",
)
def byte_class_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and runs of each class, by language; each text is mapped by a table where it lies. A null text has no characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str | None, np.ndarray] = {}
            for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cls = class_of(code_points(t or ""))
                new = cls[np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))] if len(cls) else cls
                total[lang] = total.get(lang, 0) + np.stack([np.bincount(x, minlength=6) for x in (cls, new)])
            rows = [(lang, CLASSES[k], int(n[0, k]), int(n[1, k])) for lang, n in total.items() for k in range(6) if n[0, k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "cls", "n", "m"])

    got = table(spark, sf_dir, "documents").select("lang", "text").mapInArrow(run, "lang string, cls string, n bigint, m bigint")
    return got.groupBy("lang", "cls").agg(F.sum("n").alias("n_chars"), F.sum("m").alias("n_runs"))
