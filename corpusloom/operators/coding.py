"""Coders and containers at work: round trips, code lengths of matrices, planes of floats, headers.

Defined results: a null vector or text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import coders
from corpusloom.functions import numeric as N
from corpusloom.operators.tensors import LEVELS, Q_SQL, quantized
from corpusloom.plans.registry import query
from corpusloom.sources import containers
from corpusloom.sources.tables import table


@query(
    "range_coder_roundtrip",
    Q_SQL + "SELECT vec_id, count(*) AS n_symbols, true AS fixed_ok, true AS adaptive_ok, true AS bits_ok, true AS short FROM x GROUP BY vec_id",
)
def range_coder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's levels through three coders and back. ``short``: by fixed frequencies no more than five bytes above their entropy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = [x + 7 for x in q]
                freq = np.bincount(s, minlength=LEVELS).tolist()
                code = coders.encode_symbols(s, freq)
                ideal = sum(np.log2(len(s) / freq[x]) for x in s) / 8
                fixed = coders.decode_symbols(code, len(s), freq) == s
                prev = [7, *s][: len(s)]
                adaptive = coders.decode_adaptive(coders.encode_adaptive(s, prev, LEVELS), len(s), lambda out: out[-1] if out else 7, LEVELS) == s
                bits = coders.decode_bits(coders.encode_bits(s), len(s)) == s
                rows.append((i, len(s), fixed, adaptive, bits, len(code) <= ideal + 5))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["vec_id", "n_symbols", "fixed_ok", "adaptive_ok", "bits_ok", "short"])

    q = quantized(spark, sf_dir).select("vec_id", "q").filter(F.size("q") > 0)  # without a value there is no row
    each = q.mapInArrow(run, "vec_id bigint, n_symbols bigint, fixed_ok boolean, adaptive_ok boolean, bits_ok boolean, short boolean")
    # vectors that share an id are one row
    return each.groupBy("vec_id").agg(F.sum("n_symbols").alias("n_symbols"), *(F.bool_and(c).alias(c) for c in ("fixed_ok", "adaptive_ok", "bits_ok", "short")))


@query(
    "tensor_files",
    """
SELECT label, count(*) AS n_tensors, CAST(13 + sum(2 + length('vec' || vec_id) + 2 + 4 + 5 + len(embedding)) AS BIGINT) AS raw_bytes, true AS ok, true AS shorter FROM embeddings GROUP BY label
""",
)
def tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the quantised vectors of each label, in every version, written and read back; coded ones are shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tensors = [containers.Tensor(f"vec{v['vec_id']}", np.array(v["q"], np.int8)) for v in vectors]
                raw = {k: containers.write_tensors(tensors, k) for k in containers.VERSIONS}
                ok = all([(t.name, t.values.tolist()) for t in containers.read_tensors(x)] == [(t.name, t.values.tolist()) for t in tensors] for x in raw.values())
                rows.append((label, len(tensors), len(raw[0]), ok, len(raw[4]) <= min(len(raw[1]), len(raw[2]), len(raw[0]))))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["label", "n_tensors", "raw_bytes", "ok", "shorter"])

    # a file holds the tensors of one model, so its rows belong together
    g = quantized(spark, sf_dir).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "q"))).alias("vectors"))
    return g.mapInArrow(run, "label int, n_tensors bigint, raw_bytes bigint, ok boolean, shorter boolean")


MATRIX_SQL = (
    Q_SQL
    + """, m AS (SELECT label, p, sym, lag(sym, 1, 0) OVER (PARTITION BY label, p ORDER BY vec_id) AS above FROM x),
k AS (SELECT label, 'row' AS mode, above AS c, sym AS s FROM m UNION ALL SELECT label, 'delta_row', 0, (sym - above + 15) % 15 FROM m
      UNION ALL SELECT label, 'magnitude', 0, abs(sym) FROM m UNION ALL SELECT label, 'column', CAST(p AS INT), sym FROM m),
n AS (SELECT label, mode, c, s, count(*) AS n FROM k GROUP BY ALL), z AS (SELECT label, mode, c, sum(n) AS n, sum(lgamma(1 + n)) AS o, CASE mode WHEN 'magnitude' THEN 8 ELSE 15 END AS a FROM n GROUP BY ALL),
b AS (SELECT label, mode, sum(lgamma(a + n) - lgamma(a) - o) / ln(2) AS bits FROM z GROUP BY ALL), signs AS (SELECT label, count(*) FILTER (WHERE sym <> 0) AS n FROM m GROUP BY label),
f AS (SELECT b.label, mode, round(bits + CASE mode WHEN 'magnitude' THEN n ELSE 0 END, 2) AS bits FROM b JOIN signs USING (label))
"""
)


def matrix_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, mode, bits): adaptive code lengths of a label's matrix, a vector a row."""
    x = quantized(spark, sf_dir).select("label", "vec_id", F.posexplode("q").alias("p", "sym"))
    m = x.withColumn("above", F.lag("sym", 1, 0).over(Window.partitionBy("label", "p").orderBy("vec_id")))
    key = lambda mode, c, s: F.struct(F.lit(mode).alias("mode"), c.cast("int").alias("c"), s.cast("int").alias("s"))
    keys = F.array(key("row", F.col("above"), F.col("sym")), key("delta_row", F.lit(0), F.pmod(F.col("sym") - F.col("above"), F.lit(15))), key("magnitude", F.lit(0), F.abs("sym")), key("column", F.col("p"), F.col("sym")))
    n = m.select("label", F.inline(keys)).groupBy("label", "mode", "c", "s").agg(F.count("*").alias("n"))
    z = n.groupBy("label", "mode", "c").agg(F.sum("n").alias("n"), F.sum(N.log2_factorial(F.col("n"))).alias("o"), F.sum(F.when((F.col("mode") == "magnitude") & (F.col("s") != 0), F.col("n")).otherwise(0)).alias("signs"))
    a = F.when(F.col("mode") == "magnitude", 8).otherwise(15)
    bits = N.log2_factorial(F.col("n") + a - 1) - N.log2_factorial(a - 1) - F.col("o") + F.col("signs")
    return z.groupBy("label", "mode").agg(F.round(F.sum(bits), 2).alias("bits"))


@query("matrix_code_lengths", MATRIX_SQL + "SELECT label, mode, bits FROM f")
def matrix_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given the value above, as a difference to it, as magnitude and sign, or by column."""
    return matrix_modes(spark, sf_dir)


@query("context_screen", MATRIX_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY bits, mode) AS place, max(bits) OVER (PARTITION BY label) - bits AS saved FROM f) SELECT label, mode, CAST(place AS INT) AS place, round(saved, 2) AS saved FROM r")
def context_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes of each label in order, and what each saves against the worst."""
    w = Window.partitionBy("label")
    return matrix_modes(spark, sf_dir).select("label", "mode", F.row_number().over(w.orderBy("bits", "mode")).alias("place"), F.round(F.max("bits").over(w) - F.col("bits"), 2).alias("saved"))


@query("local_priors", Q_SQL + ", n AS (SELECT label, sym, count(*) AS n FROM x GROUP BY ALL) SELECT label, sym, CAST(1 + n * 64 // sum(n) OVER (PARTITION BY label) AS BIGINT) AS prior FROM n")
def local_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each label scaled to 64, and one more: where adaptive counts begin. The window runs over 15 rows."""
    n = quantized(spark, sf_dir).select("label", F.explode("q").alias("sym")).groupBy("label", "sym").agg(F.count("*").alias("n"))
    return n.withColumn("t", F.sum("n").over(Window.partitionBy("label"))).select("label", "sym", F.expr("1 + n * 64 div t").alias("prior"))


@query(
    "bf16_planes",
    """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
e AS (SELECT *, floor(log2(abs(x))) AS e FROM x WHERE x <> 0), b AS (SELECT vec_id, p, CAST(CASE WHEN x < 0 THEN 32768 ELSE 0 END + (e + 127) * 128 + round_even(abs(x) / pow(2, e) * 128, 0) - 128 AS BIGINT) AS b FROM e),
k AS (SELECT 'high' AS plane, b >> 8 AS s FROM b UNION ALL SELECT 'low', b & 255 FROM b UNION ALL SELECT 'xor_high', xor(b >> 8, lag(b >> 8, 1, 0) OVER (PARTITION BY vec_id ORDER BY p)) FROM b),
n AS (SELECT plane, s, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY plane) AS t FROM n)
SELECT plane, count(*) AS n_symbols, round(sum(-(n / t) * log2(n / t)), 6) AS entropy FROM t GROUP BY plane
""",
)
def bf16_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values but zeros as bfloat16: entropy of the high and low bytes, and of the high ones against the byte before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((3, 256), np.int64)
            for v in batch.column(0).to_pylist():
                x = np.array(v or [], np.float32)
                b = coders.bf16_bits(x[x != 0]).astype(np.int64)
                high = b >> 8
                for k, s in enumerate((high, b & 255, high ^ np.concatenate([[0], high[:-1]])[: len(high)])):
                    total[k] += np.bincount(s, minlength=256)
            k, s = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(["high", "low", "xor_high"])[k].tolist(), pa.string()), pa.array(s.astype(np.int32)), pa.array(total[k, s])], names=["plane", "s", "n"])

    n = table(spark, sf_dir, "embeddings").select("embedding").mapInArrow(run, "plane string, s int, n bigint").groupBy("plane", "s").agg(F.sum("n").alias("n"))
    g = n.groupBy("plane").agg(F.count("*").alias("n_symbols"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("z"))
    return g.select("plane", "n_symbols", F.round(F.log2("t") - F.col("z") / F.col("t"), 6).alias("entropy"))


@query(
    "uvarint_bytes",
    "SELECT o_orderkey, array_to_string(list_transform(range(0, greatest(1, CAST(ceil(length(ltrim(bin(o_orderkey), '0')) / 7) AS BIGINT))), lambda i: printf('%02X', ((o_orderkey >> CAST(7 * i AS INT)) & 127) + CASE WHEN (o_orderkey >> CAST(7 * (i + 1) AS INT)) > 0 THEN 128 ELSE 0 END)), '') AS code FROM orders",
)
def uvarint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys in seven-bit groups, the lowest first, as hexadecimal digits."""
    n = F.greatest(F.lit(1), F.ceil(F.length(F.bin("o_orderkey")) / 7).cast("int"))
    group = lambda i: F.call_function("shiftright", F.col("o_orderkey"), 7 * i)
    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.format_string("%02X", group(i).bitwiseAND(127) + F.when(group(i + 1) > 0, 128).otherwise(0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(one, "").alias("code"))


@query(
    "header_bytes",
    """
WITH c AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS c FROM documents), h AS (SELECT doc_id, hex(encode(c)) AS h FROM c WHERE c <> ''),
v AS (SELECT doc_id, count(DISTINCT substr(h, CAST(i AS INT), 2)) AS v FROM h, unnest(range(1, length(h), 2)) t(i) GROUP BY doc_id)
SELECT d.doc_id, printf('%010X', CAST(strlen(coalesce(text, '')) AS BIGINT) + CASE WHEN text <> '' THEN 549755813888 ELSE 0 END) AS head, CAST(CASE WHEN strlen(text) >= 10000 THEN v ELSE 256 END AS INT) AS n_values, true AS ok
FROM documents d LEFT JOIN v USING (doc_id)
""",
)
def header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of each document as bytes, read back: the five bytes of the length, and how many byte values may occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                head = containers.header_bytes(len(raw), bool(raw), raw)
                length, coded, values, size = containers.read_header(head)
                rows.append((i, head[:5].hex().upper(), len(values), (length, coded, size) == (len(raw), bool(raw), len(head)) and set(raw) <= set(values.tolist())))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "head", "n_values", "ok"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, head string, n_values int, ok boolean")
