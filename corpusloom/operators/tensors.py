"""Arrays of numbers: quantisation, code lengths, choice of encodings, norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.operators.symbols import log2_factorials
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

LEVELS = 15
Q_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT *, greatest(list_max(list_transform(e, lambda x: abs(x))), 1e-12) / 7 AS scale FROM v),
q AS (SELECT vec_id, label, e, scale, list_transform(e, lambda x: CAST(greatest(-7, least(7, round_even(x / scale, 0))) AS INT)) AS q FROM s),
x AS (SELECT vec_id, label, unnest(q) AS sym, generate_subscripts(q, 1) AS p FROM q)
"""
LF = "(lgamma(15 + n) - lgamma(15) - o) / ln(2)"


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.withColumn("scale", F.greatest(F.array_max(F.transform("e", F.abs)), F.lit(1e-12)) / 7)
    return v.withColumn("q", N.quantize(F.col("e"), F.col("scale"), -7, 7))


def histogram(q: Column) -> Column:
    """Counts of the 15 levels."""
    return F.transform(F.sequence(F.lit(-7), F.lit(7)), lambda s: F.size(F.filter(q, lambda x: x == s)))


@query(
    "quantize_15",
    Q_SQL + "SELECT vec_id, round(scale, 6) AS scale, CAST(list_sum(q) AS BIGINT) AS q_sum, round(list_sum(list_transform(e, lambda x, i: (x / scale - q[i]) ** 2)), 5) AS err FROM q",
)
def quantize_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen levels with a scale per vector, and the squared error that this leaves, in units of the scale."""
    v = quantized(spark, sf_dir)
    err = F.zip_with("e", "q", lambda x, y: F.pow(x / F.col("scale") - y, 2))
    # before the select, lest its alias "scale" be taken for the column within the lambda
    v = v.withColumn("err", F.round(N.total(err), 5))
    return v.select("vec_id", F.round("scale", 6).alias("scale"), F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("q_sum"), "err")


@query(
    "requantize_fixed_point",
    Q_SQL + "SELECT count(*) AS n, 0 AS n_changed FROM q",
)
def requantize_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantising what was dequantised gives the same levels."""
    v = quantized(spark, sf_dir)
    again = N.quantize(F.transform("q", lambda x: x * F.col("scale")), F.col("scale"), -7, 7)
    return v.agg(F.count("*").alias("n"), F.count_if(again != F.col("q")).cast("int").alias("n_changed"))


CANDIDATES_SQL = f"""
, d AS (SELECT vec_id, label, p, sym, (sym - lag(sym, 1, 0) OVER (PARTITION BY vec_id ORDER BY p) + 30) % 15 AS del FROM x),
a AS (SELECT vec_id, sum(n) AS n, sum(lgamma(1 + n)) AS o FROM (SELECT vec_id, sym, count(*) AS n FROM d GROUP BY ALL) GROUP BY vec_id),
b AS (SELECT vec_id, sum(n) AS n, sum(lgamma(1 + n)) AS o FROM (SELECT vec_id, del, count(*) AS n FROM d GROUP BY ALL) GROUP BY vec_id),
c AS (SELECT vec_id, 0 AS mode, n * log2(15) AS bits FROM a UNION ALL SELECT vec_id, 1, {LF} FROM a UNION ALL SELECT vec_id, 2, {LF} FROM b)
"""


@query("best_encoding", Q_SQL + CANDIDATES_SQL + "SELECT vec_id, CAST(arg_min(mode, round(bits, 3) * 1000000 + mode) AS INT) AS mode, round(min(bits), 3) AS bits FROM c GROUP BY vec_id")
def best_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of: fixed length, adaptive symbols, adaptive differences modulo 15; ties to the lower mode."""
    v = quantized(spark, sf_dir)
    prev = F.concat(F.array(F.lit(0)), F.slice("q", 1, F.size("q") - 1))
    delta = F.transform(F.zip_with("q", prev, lambda x, y: F.pmod(x - y, F.lit(15))), lambda x: (x - 7).cast("int"))
    bits = F.array(F.size("q") * F.log2(F.lit(15.0)), N.adaptive_bits(histogram(F.col("q")), LEVELS), N.adaptive_bits(histogram(delta), LEVELS))
    best = F.array_min(F.transform(bits, lambda b, m: F.struct(F.round(b, 3).alias("bits"), m.alias("mode"))))
    return v.select("vec_id", best.alias("b")).select("vec_id", "b.mode", "b.bits")


@query(
    "conditional_code_lengths",
    Q_SQL
    + """, d AS (SELECT vec_id, label, sym, lag(sym, 1, 0) OVER (PARTITION BY vec_id ORDER BY p) AS c1, lag(sym, 2, 0) OVER (PARTITION BY vec_id ORDER BY p) AS c2 FROM x),
k AS (SELECT 'order0' AS context, label, vec_id, 0 AS c, sym FROM d UNION ALL SELECT 'prev', label, vec_id, c1, sym FROM d UNION ALL SELECT 'prev2', label, vec_id, c1 * 100 + c2, sym FROM d),
n AS (SELECT context, label, vec_id, c, sym, count(*) AS n FROM k GROUP BY ALL),
g AS (SELECT context, label, lgamma(15 + sum(n)) - lgamma(15) - sum(lgamma(1 + n)) AS nats FROM n GROUP BY context, label, vec_id, c)
SELECT context, label, round(sum(nats) / ln(2), 2) AS bits FROM g GROUP BY ALL""",
)
def conditional_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive code lengths given nothing, the previous symbol, or the previous two. Each vector is folded where it lies; only totals of a label are grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, float] = {}
            for label, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sym = np.array(q, np.int64)
                back = [np.concatenate([np.zeros(k, np.int64), sym])[: len(sym)] for k in (1, 2)]
                for name, ctx in (("order0", 0 * sym), ("prev", back[0]), ("prev2", back[0] * 100 + back[1])):
                    total[name, label] = total.get((name, label), 0.0) + add_one_bits(ctx, sym, LEVELS)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.float64())], names=["context", "label", "bits"])

    got = quantized(spark, sf_dir).filter("q IS NOT NULL").select("label", "q").mapInArrow(run, "context string, label int, bits double")
    return got.groupBy("context", "label").agg(F.round(F.sum("bits"), 2).alias("bits"))


def add_one_bits(ctx: np.ndarray, sym: np.ndarray, alphabet: int) -> float:
    """Bits of an adaptive model with add-one counts in each context, in closed form."""
    if not len(sym):
        return 0.0
    pair = np.unique(ctx * 1000 + sym, return_counts=True)[1]
    per = np.unique(ctx, return_counts=True)[1]
    f = log2_factorials(int(per.max()) + alphabet + 1)
    return float((f[per + alphabet - 1] - f[alphabet - 1]).sum() - f[pair].sum())


@query(
    "normalized_histogram",
    Q_SQL
    + """, n AS (SELECT label, sym, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT *, n * 4096 AS z, sum(n) OVER (PARTITION BY label) AS t FROM n),
f AS (SELECT label, sym, z // t AS f, z % t AS r FROM t), k AS (SELECT *, 4096 - sum(f) OVER (PARTITION BY label) AS left_over, row_number() OVER (PARTITION BY label ORDER BY r DESC, sym) AS i FROM f)
SELECT label, sym, CAST(f + CASE WHEN i <= left_over THEN 1 ELSE 0 END AS BIGINT) AS freq FROM k""",
)
def normalized_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level counts of each label scaled to 4096 by largest remainders. The windows run over 15 rows."""
    n = quantized(spark, sf_dir).select("label", F.explode("q").alias("sym")).groupBy("label", "sym").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    t = n.withColumn("t", F.sum("n").over(w)).select("label", "sym", F.expr("n * 4096 div t").alias("f"), F.expr("n * 4096 % t").alias("r"))
    k = t.withColumn("left_over", 4096 - F.sum("f").over(w)).withColumn("i", F.row_number().over(w.orderBy(F.desc("r"), "sym")))
    return k.select("label", "sym", (F.col("f") + F.when(F.col("i") <= F.col("left_over"), 1).otherwise(0)).alias("freq"))


@query(
    "sparsity_report",
    Q_SQL
    + """, z AS (SELECT label, vec_id, len(list_filter(q, lambda y: y <> 0)) AS nz, list_max(list_transform(q, lambda y: abs(y))) AS top FROM q)
SELECT label, count(*) AS n, round(avg(nz), 6) AS mean_nonzero, quantile_cont(nz, 0.5) AS median_nonzero, round(quantile_cont(nz, 0.99), 6) AS p99_nonzero, CAST(max(top) AS INT) AS max_abs FROM z GROUP BY label""",
)
def sparsity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(spark, sf_dir).select("label", F.size(F.filter("q", lambda x: x != 0)).alias("nz"), F.array_max(F.transform("q", F.abs)).alias("top"))
    return v.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.avg("nz"), 6).alias("mean_nonzero"),
        F.percentile("nz", F.lit(0.5)).alias("median_nonzero"),
        F.round(F.percentile("nz", F.lit(0.99)), 6).alias("p99_nonzero"),
        F.max("top").alias("max_abs"),
    )


@query(
    "vector_functions",
    """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
a AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) AS ss, list_sum(e) / len(e) AS mean, abs(label) % len(e) AS t,
      list_transform(e, lambda x: 15 * (exp(2 * x / 15) - 1) / (exp(2 * x / 15) + 1)) AS capped FROM v),
b AS (SELECT *, list_sum(list_transform(capped, lambda x: exp(x))) AS z FROM a)
SELECT vec_id, round(sqrt(ss / len(e) + 1e-6), 6) AS rms, round(sqrt(list_sum(list_transform(e, lambda x: (x - mean) ** 2)) / len(e)), 6) AS spread,
       round(list_sum(list_transform(e, lambda x: greatest(x, 0) ** 2)), 5) AS relu2_sum,
       round(-ln(exp(capped[CAST(t + 1 AS INT)]) / z), 6) AS nats, round(list_sum(list_transform(e, lambda x: CASE WHEN x > 20 THEN x ELSE ln(1 + exp(x)) END)), 5) AS softplus_sum,
       CAST(list_sum(list_transform(e, lambda x: greatest(-128, least(127, round_even(x / 0.02, 0))))) AS BIGINT) AS i8_sum
FROM b
""",
)
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms, activations, capped softmax loss and 8-bit quantisation of each vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = F.col("e")
    squares = N.total(F.transform(e, lambda x: x * x))
    return v.select(
        "vec_id",
        F.round(F.sqrt(squares / F.size(e) + 1e-6), 6).alias("rms"),
        F.round(F.sqrt(N.total(F.transform(N.mean_zero(e), lambda x: x * x)) / F.size(e)), 6).alias("spread"),
        F.round(N.total(N.relu2(e)), 5).alias("relu2_sum"),
        F.round(N.neg_log_prob(N.softmax(N.softcap(e)), F.abs("label") % F.size(e)), 6).alias("nats"),
        F.round(N.total(F.transform(e, N.softplus)), 5).alias("softplus_sum"),
        F.aggregate(N.quantize(e, F.lit(0.02), -128, 127), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("i8_sum"),
    )


@query(
    "rope_rotation",
    """
WITH v AS (SELECT vec_id, vec_id % 1024 AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, e, len(e) AS d, unnest(range(0, len(e) // 2)) AS i, pos FROM v),
r AS (SELECT vec_id, e[2 * i + 1] AS x, e[2 * i + 2] AS y, pos / pow(10000.0, 2.0 * i / d) AS a, i FROM p)
SELECT vec_id, round(sum(x * cos(a) - y * sin(a)), 5) AS even_sum, round(sum(x * sin(a) + y * cos(a)), 5) AS odd_sum FROM r GROUP BY vec_id
""",
)
def rope_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", N.rope(F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id") % 1024).alias("r"))
    part = lambda k: F.round(N.total(F.filter("r", lambda x, i: i % 2 == k)), 5)
    return v.select("vec_id", part(0).alias("even_sum"), part(1).alias("odd_sum"))


@query("uvarint_lengths", "SELECT CAST(greatest(1, ceil(length(bin(o_orderkey)) / 7)) AS INT) AS n_bytes, count(*) AS n FROM orders GROUP BY 1")
def uvarint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(N.uvarint_length(F.col("o_orderkey")).alias("n_bytes")).agg(F.count("*").alias("n"))


@query("learning_rate_schedule", "SELECT o_orderkey, round(CASE WHEN f < 0.05 THEN (1 - cos(3.141592653589793 * f / 0.05)) / 2 ELSE (cos(3.141592653589793 * (f - 0.05) / 0.95) + 1) / 2 END, 6) AS multiplier FROM (SELECT o_orderkey, o_orderkey / (SELECT max(o_orderkey) FROM orders)::DOUBLE AS f FROM orders)")
def learning_rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiplier at each step, steps numbered by the order keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    top = o.agg(F.max("o_orderkey").alias("top"))
    return o.crossJoin(top).select("o_orderkey", F.round(N.learning_rate(F.col("o_orderkey") / F.col("top")), 6).alias("multiplier"))  # top is one row
