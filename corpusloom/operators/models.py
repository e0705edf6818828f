"""Model evaluation: blocks, headers, expert combination, priors, orders of context, planes, differences, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.operators.causal import CONFIDENCE_SQL, confidence
from corpusloom.operators.matching import previous
from corpusloom.operators.symbols import code_points, order_k_bits
from corpusloom.operators.words import word_ids
from corpusloom.plans.registry import query
from corpusloom.sources.tables import header, table


@query(
    "block_types",
    r"""
WITH d AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x09-\x0D\x20-\x7E]', '', 'g')) AS ascii, length(regexp_replace(text, '[^ ]', '', 'g')) AS blanks FROM documents)
SELECT doc_id, CASE WHEN n > 0 AND ascii > 0.95 * n AND blanks >= 5 THEN 'TEXT' ELSE 'DEFAULT' END AS block_type, CAST(n - ascii AS INT) AS n_other FROM d
""",
)
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a text block if over 95 % of it is ASCII text with five blanks or more."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.length(F.regexp_replace("text", r"[^\x09-\x0D\x20-\x7E]", "")).alias("a"), F.length(F.regexp_replace("text", "[^ ]", "")).alias("b"))
    text = (F.col("n") > 0) & (F.col("a") > 0.95 * F.col("n")) & (F.col("b") >= 5)
    return d.select("doc_id", F.when(text, "TEXT").otherwise("DEFAULT").alias("block_type"), (F.col("n") - F.col("a")).alias("n_other"))


@query(
    "document_headers",
    """
WITH d AS (SELECT doc_id, strlen(text) AS n, CASE WHEN text = '' THEN 0 ELSE len(list_distinct(string_split(text, ''))) END AS v FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS length, n > 0 AS dict_used, CAST(CASE WHEN n >= 10000 THEN v END AS INT) AS vocab_size FROM d
""",
)
def document_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of each document: its bytes, whether it is coded, and from 10,000 bytes on its vocabulary."""
    n = F.octet_length("text")
    d = table(spark, sf_dir, "documents").select("doc_id", header(n, n > 0, F.array_distinct(F.split("text", ""))).alias("h"))
    return d.select("doc_id", "h.length", "h.dict_used", F.when(F.col("h.vocab").isNotNull(), F.size("h.vocab")).alias("vocab_size"))


EXPERTS_SQL = (
    CONFIDENCE_SQL
    + """, b AS (SELECT event_type, avg(hit) AS base FROM e GROUP BY event_type),
x AS (SELECT c.event_type, hit, least(0.999999, greatest(0.000001, p)) AS p, base FROM c JOIN b USING (event_type)),
l AS (SELECT event_type, hit, base, coalesce(ln(p / (1 - p)), 0) AS l1, ln(base / (1 - base)) AS l2 FROM x)
"""
)


def experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, hit, l1, l2): the logits of the running confidence (0 while it is silent) and of the type's rate."""
    c = confidence(spark, sf_dir)
    base = c.groupBy("event_type").agg(F.avg("hit").alias("base"))
    return c.join(base, "event_type").select("event_type", "hit", N.silent(N.stretch(F.col("p"))).alias("l1"), F.ln(F.col("base") / (1 - F.col("base"))).alias("l2"))


@query(
    "expert_mixture",
    EXPERTS_SQL
    + """, m AS (SELECT event_type, hit, 1 / (1 + exp(-(0.25 * l1 + 0.75 * l2))) AS q, CASE WHEN abs(l1 - l2) > 0.5 THEN l1 END AS disagreeing, CASE WHEN greatest(1 / (1 + exp(-l2)), 1 - 1 / (1 + exp(-l2))) < 0.75 THEN l1 END AS unsure FROM l)
SELECT event_type, count(*) AS n, round(avg(-ln(CASE hit WHEN 1 THEN q ELSE 1 - q END)) / ln(2), 6) AS bits, count(disagreeing) AS n_disagreeing, count(unsure) AS n_unsure FROM m GROUP BY event_type""",
)
def expert_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experts mixed in the logistic domain: cost per event, and where the first disagrees with or speaks besides an unsure second."""
    x = experts(spark, sf_dir)
    q = N.logistic(0.25 * F.col("l1") + 0.75 * F.col("l2"))
    sure = N.logistic(F.col("l2"))
    return x.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg(-F.ln(F.when(F.col("hit") == 1, q).otherwise(1 - q))) / F.ln(F.lit(2.0)), 6).alias("bits"),
        F.count_if(F.abs(F.col("l1") - F.col("l2")) > 0.5).alias("n_disagreeing"),
        F.count_if(F.greatest(sure, 1 - sure) < 0.75).alias("n_unsure"),
    )


@query(
    "prior_fallback",
    CONFIDENCE_SQL
    + """, b AS (SELECT event_type, avg(hit) AS base FROM e GROUP BY event_type)
SELECT CASE WHEN p IS NULL THEN 'prior' ELSE 'model' END AS source, count(*) AS n, round(avg(-ln(greatest(1e-6, CASE hit WHEN 1 THEN coalesce(p, base) ELSE 1 - coalesce(p, base) END))), 6) AS nats FROM c JOIN b USING (event_type) GROUP BY 1""",
)
def prior_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss by source: the running model where it speaks, else the type's rate."""
    c = confidence(spark, sf_dir)
    base = c.groupBy("event_type").agg(F.avg("hit").alias("base"))
    p = F.coalesce("p", "base")
    c = c.join(base, "event_type").select(F.when(F.col("p").isNull(), "prior").otherwise("model").alias("source"), F.greatest(F.lit(1e-6), F.when(F.col("hit") == 1, p).otherwise(1 - p)).alias("q"))
    return c.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(-F.ln("q")), 6).alias("nats"))


@query(
    "order_k_bits_by_lang",
    """
WITH ch AS (SELECT doc_id, lang, c, p FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents) WHERE c <> ''),
x AS (SELECT doc_id, lang, c, lag(c, 1, '') OVER w AS c1, lag(c, 2, '') OVER w AS c2 FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT 0 AS k, doc_id, lang, '' AS ctx, c FROM x UNION ALL SELECT 1, doc_id, lang, c1, c FROM x UNION ALL SELECT 2, doc_id, lang, c2 || '|' || c1, c FROM x),
n AS (SELECT k, doc_id, lang, ctx, c, count(*) AS n FROM k GROUP BY ALL),
g AS (SELECT k, lang, lgamma(256 + sum(n)) - lgamma(256) - sum(lgamma(1 + n)) AS nats FROM n GROUP BY k, doc_id, lang, ctx)
SELECT CAST(k AS INT) AS k, lang, round(sum(nats) / ln(2), 1) AS bits FROM g GROUP BY k, lang
""",
)
def order_k_bits_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive code lengths of orders 0, 1 and 2, summed by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[int, str], float] = {}
            for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cp = code_points(t or "")
                for k in range(3):
                    total[k, lang] = total.get((k, lang), 0.0) + order_k_bits(cp, k)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([x for _, x in total], pa.string()), pa.array(list(total.values()), pa.float64())], names=["k", "lang", "bits"])

    got = table(spark, sf_dir, "documents").select("lang", "text").mapInArrow(run, "k int, lang string, bits double")
    return got.groupBy("k", "lang").agg(F.round(F.sum("bits"), 1).alias("bits"))


@query(
    "byte_planes",
    """
WITH p AS (SELECT k, (o_orderkey >> CAST(8 * k AS INT)) & 255 AS byte FROM orders, range(8) t(k) WHERE o_orderkey IS NOT NULL),
n AS (SELECT k, byte, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM n)
SELECT CAST(k AS INT) AS plane, count(*) AS n_symbols, round(sum(-(n / t) * log2(n / t)), 6) AS entropy FROM s GROUP BY k
""",
)
def byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight byte planes of the order keys: symbols and entropy. A null key has no bytes."""
    planes = F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), F.expr(f"shiftright(o_orderkey, {8 * k}) & 255").alias("byte")) for k in range(8)]))
    n = table(spark, sf_dir, "orders").filter("o_orderkey IS NOT NULL").select(planes.alias("x")).groupBy("x.plane", "x.byte").agg(F.count("*").alias("n"))
    g = n.groupBy("plane").agg(F.count("*").alias("n_symbols"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return g.select("plane", "n_symbols", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


@query(
    "first_difference",
    """
WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS a, unnest(string_split(translate(html, 'XYZxyz', 'xyzXYZ'), '')) AS b, generate_subscripts(string_split(html, ''), 1) AS p FROM pages)
SELECT page_id, CAST(coalesce(min(p - 1) FILTER (WHERE a <> b), -1) AS INT) AS first_difference, count(*) FILTER (WHERE a <> b) AS n_different FROM c GROUP BY page_id
""",
)
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a page and an altered copy of it part, and in how many characters."""
    p = table(spark, sf_dir, "pages").withColumn("d", F.zip_with(F.split("html", ""), F.split(F.translate("html", "XYZxyz", "xyzXYZ"), ""), lambda a, b: a != b))
    return p.select("page_id", (F.array_position("d", True) - 1).cast("int").alias("first_difference"), F.size(F.filter("d", lambda x: x)).cast("bigint").alias("n_different"))


@query(
    "indirect_context_hits",
    """
WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type, 1) OVER w AS c1, lag(event_type, 2) OVER w AS c2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id, c1, c2 ORDER BY ts, event_id) AS guess FROM e WHERE c2 IS NOT NULL)
SELECT event_type, count(guess) AS n_predicted, count(*) FILTER (WHERE guess = event_type) AS n_hit FROM g GROUP BY event_type
""",
)
def indirect_context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed a user's last two event types the time before, against what follows now."""
    u = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    e = e.withColumn("c1", F.lag("event_type", 1).over(u)).withColumn("c2", F.lag("event_type", 2).over(u)).filter("c2 IS NOT NULL")
    e = e.withColumn("guess", F.lag("event_type").over(Window.partitionBy("user_id", "c1", "c2").orderBy("ts", "event_id")))
    return e.groupBy("event_type").agg(F.count("guess").alias("n_predicted"), F.count_if(F.col("guess") == F.col("event_type")).alias("n_hit"))


@query(
    "context_distance",
    """
WITH t AS (SELECT row_number() OVER () AS doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM t),
d AS (SELECT p - lag(p) OVER (PARTITION BY doc_id, w ORDER BY p) AS d FROM x)
SELECT CAST(floor(log2(d)) AS INT) AS log_distance, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1
""",
)
def context_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the last same word, by power of two. Words are lined up within their document; nothing is exploded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(64, np.int64)
            for t in batch.column(0).to_pylist():
                ids = word_ids(t)
                prev = previous(ids)
                at = np.flatnonzero(prev >= 0)
                total += np.bincount(np.frexp((at - prev[at]).astype(float))[1] - 1, minlength=64)
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["log_distance", "n"])

    got = table(spark, sf_dir, "documents").select("text").mapInArrow(run, "log_distance int, n bigint")
    return got.groupBy("log_distance").agg(F.sum("n").alias("n"))


@query(
    "user_sessions",
    """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM e ORDER BY user_id, ts)),
g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM g GROUP BY user_id
""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, closed by six hours of silence (an extension: the time analogue of a reset at a boundary)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("k", F.sum("new").over(w)).groupBy("user_id", "k").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
