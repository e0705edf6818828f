"""Datasets: pieces, splits, order, packing, shifts, masks, metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.ordered import ordered
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

PIECE = 2048
PACK = 8192


@query(
    "reorder_with_remainder",
    """
WITH l AS (SELECT doc_id, quality FROM labels),
o AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 1 - l.quality END AS section FROM documents d LEFT JOIN l USING (doc_id))
SELECT doc_id, section, row_number() OVER (ORDER BY section, doc_id) - 1 AS position FROM o
""",
)
def reorder_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed documents first (good ones before the others), then every unlisted one; each with its new place."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    listed = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("section"))
    both = docs.join(listed, "doc_id").unionByName(docs.join(listed, "doc_id", "left_anti").withColumn("section", F.lit(2)))
    return ordered(both, "doc_id", section=F.col("section")).select("doc_id", "section", F.col("pos").alias("position"))


@query(
    "split_pieces",
    """
WITH p AS (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(1, length(text)), 2048)) AS start FROM documents)
SELECT doc_id, CAST(start // 2048 AS INT) AS piece, CAST(start AS INT) AS start, CAST(least(2048, n - start) AS INT) AS length FROM p
""",
)
def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of at most 2048 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(0, n - 1) div {PIECE}").cast("int"))).alias("piece"))
    return d.select("doc_id", "piece", (F.col("piece") * PIECE).alias("start"), F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).alias("length"))


@query(
    "train_val_split",
    """
WITH d AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, i % 10 = 0 AS validation, CAST(n AS INT) AS length, CAST(coalesce(sum(n) OVER (PARTITION BY i % 10 = 0 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d
""",
)
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document validates; both parts get offsets of their own."""
    d = ordered(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("length")), "doc_id")
    d = d.select("doc_id", "length", (F.col("pos") % 10 == 0).alias("validation"))
    out = ordered(d, "doc_id", add=F.col("length"), section=F.col("validation"), within=True)
    return out.select("doc_id", "validation", "length", F.col("before").alias("start"))


@query(
    "boundary_checks",
    """
WITH d AS (SELECT length(text) AS n FROM documents)
SELECT 'empty' AS rule, count(*) FILTER (WHERE n = 0) AS broken FROM d
UNION ALL SELECT 'repeated id', (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents))
UNION ALL SELECT 'n_chars', (SELECT count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) FROM documents)
""",
)
def boundary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of the document boundaries: counts of rows that break a rule. Null ids are one id; a null text isn't empty."""
    d = table(spark, sf_dir, "documents")
    one = d.agg(F.count_if(F.length("text") == 0).alias("a"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("c"))
    two = d.groupBy("doc_id").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("b"))
    rules = F.array(F.struct(F.lit("empty").alias("rule"), F.col("a").alias("broken")), F.struct(F.lit("repeated id").alias("rule"), F.col("b").alias("broken")), F.struct(F.lit("n_chars").alias("rule"), F.col("c").alias("broken")))
    return one.join(two).select(F.inline(rules))  # one row on either side


@query(
    "shift_by_one",
    """
SELECT conv_id, turn, role AS input_role, lead(role) OVER w AS target_role, md5(lead(text) OVER w) AS target_md5, lead(turn) OVER w IS NOT NULL AS mask
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""",
)
def shift_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one as its target; the last one of a conversation is masked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("role").alias("input_role"), F.lead("role").over(w).alias("target_role"), F.md5(F.encode(F.lead("text").over(w), "utf-8")).alias("target_md5"), F.lead("turn").over(w).isNotNull().alias("mask"))


@query(
    "window_mask",
    """
WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
SELECT conv_id, turn, CAST(count(*) OVER w AS INT) AS n_visible, CAST(sum(n) OVER w AS BIGINT) AS chars_visible FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
""",
)
def window_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a causal window of four turns within the same conversation sees."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return c.select("conv_id", "turn", F.count("*").over(w).cast("int").alias("n_visible"), F.sum("n").over(w).alias("chars_visible"))


def packing_sql(less: int) -> str:
    """Next-fit over the pieces in one order: the piece after which each open bin overflows, followed from the first piece on."""
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents),
q AS (SELECT doc_id, start, least({PIECE}, n - start) - {less} AS length FROM (SELECT doc_id, n, unnest(range(0, greatest(1, n), {PIECE})) AS start FROM t)),
p AS (SELECT * FROM q WHERE length > 0 OR {less} = 0),
o AS (SELECT doc_id, CAST(start // {PIECE} AS INT) AS piece, CAST(length AS INT) AS length, row_number() OVER w AS i, CAST(sum(length) OVER w AS BIGINT) AS e FROM p WINDOW w AS (ORDER BY doc_id, start ROWS UNBOUNDED PRECEDING)),
v AS (SELECT e AS at_, i, CAST(NULL AS BIGINT) AS asks FROM o UNION ALL SELECT e - length + {PACK}, NULL, i FROM o),
j AS (SELECT asks AS i, max(i) OVER (ORDER BY at_ RANGE UNBOUNDED PRECEDING) + 1 AS j FROM v),
x AS (SELECT i, j FROM j WHERE i IS NOT NULL),
f AS (SELECT CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS bin UNION ALL SELECT x.j, f.bin + 1 FROM f JOIN x ON x.i = f.i),
b AS (SELECT o.*, max(f.bin) OVER w AS bin, max(CASE WHEN f.i IS NOT NULL THEN o.e - o.length END) OVER w AS base FROM o LEFT JOIN f ON f.i = o.i WINDOW w AS (ORDER BY o.i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, piece, length, bin, CAST(e - length - base AS INT) AS start FROM b
"""


def piece_lengths(n: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these lengths: the document of each piece, the piece's number, its length less ``less``; with that, pieces of nothing are left out."""
    count = np.maximum(1, -(-n // PIECE))
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(PIECE, n[doc] - piece * PIECE) - less
    keep = (length > 0) | (less == 0)
    return doc[keep], piece[keep], length[keep]


def next_starts(length: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces when laid in a row, and for each piece the one that starts the next bin if it starts one; a piece that is longer than a bin has one of its own."""
    end = np.cumsum(length)
    return end, np.maximum(np.arange(1, len(end) + 1), np.searchsorted(end, end - length + room, side="right"))


def block_effect(length: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block does to an open bin. With room r, its first new bin starts at piece searchsorted(ends, r, right); then so many bins are opened and the last is filled so far."""
    end, after = next_starts(length, room)
    m, size = min(len(end), int(np.searchsorted(end, room, side="right")) + 1), len(end)
    bins, fill = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i in range(size - 1, -1, -1):
        j = after[i]
        bins[i], fill[i] = (1, end[-1] - end[i] + length[i]) if j == size else (1 + bins[j], fill[j])
    return end[:m], bins[:m], fill[:m]


def place_pieces(length: np.ndarray, bin_: int, fill: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and start of each piece, going on in a bin that is filled so far."""
    end, after = next_starts(length, room)
    starts, i = [], int(np.searchsorted(end, room - fill, side="right"))
    while i < len(end):
        starts.append(i)
        i = int(after[i])
    k = np.searchsorted(np.array(starts, np.int64), np.arange(len(end)), side="right")
    base = np.concatenate([[-fill], (end - length)[starts]]).astype(np.int64)
    return bin_ + k, end - length - base[k]


#: Documents of a block of the packing.
PACK_BLOCK = 4096


def pack_in_order(docs: DataFrame, less: int) -> DataFrame:
    """Next-fit packing of all pieces into bins of PACK."""
    return in_order(docs, PACK, lambda n: piece_lengths(n, less))


def block_fold(docs: DataFrame, room: int) -> DataFrame:
    """Next-fit merging of whole documents; a document that is longer than a bin is alone in one."""
    return in_order(docs, room, lambda n: (np.arange(len(n)), np.zeros(len(n), np.int64), n))


def in_order(docs: DataFrame, room: int, lengths: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Next-fit packing in one order: each block of documents tells what it does to an open bin, and one row per block carries the bin on.

    A null text has no characters; null ids come last; documents of one id come in the order of their lengths.
    """
    d = ordered(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n")), "doc_id")
    g = d.groupBy(F.expr(f"pos div {PACK_BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "n"))).alias("a")).select("block", F.col("a.doc_id").alias("ids"), F.col("a.n").alias("n"))

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                length = lengths(n.values.to_numpy())[2]
                if len(length):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([length.sum()], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in block_effect(length, room))], names=["block", "total", "ends", "bins", "fills"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_ = fill = 0
        for batch in batches:
            out = []
            for block, total, ends, bins, fills in zip(*(batch.column(k) for k in range(5)), strict=True):
                out.append((block.as_py(), bin_, fill))
                if fill + total.as_py() <= room:
                    fill += total.as_py()
                else:
                    i = int(np.searchsorted(ends.values.to_numpy(), room - fill, side="right"))
                    bin_, fill = bin_ + bins.values[i].as_py(), fills.values[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["block", "bin", "fill"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, bin_, fill in zip(*(batch.column(k) for k in range(4)), strict=True):
                doc, piece, length = lengths(n.values.to_numpy())
                bins, start = place_pieces(length, bin_.as_py(), fill.as_py(), room)
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (piece, length)), pa.array(bins, pa.int64()), pa.array(start.astype(np.int32))], names=["doc_id", "piece", "length", "bin", "start"])

    e = g.select("block", "n").mapInArrow(effects, "block bigint, total bigint, ends array<bigint>, bins array<bigint>, fills array<bigint>")
    # one row per block
    opened = e.repartition(1).sortWithinPartitions("block").mapInArrow(carry, "block bigint, bin bigint, fill bigint")
    return g.join(opened, "block").select("ids", "n", "bin", "fill").mapInArrow(place, "doc_id bigint, piece int, length int, bin bigint, start int")


@query("next_fit_pieces", packing_sql(0))
def next_fit_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-fit packing of whole pieces (as in ``split_pieces``), those without a character included."""
    return pack_in_order(table(spark, sf_dir, "documents"), 0)


@query("next_fit_packing", packing_sql(1))
def next_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-fit packing of training pairs: a piece of n symbols has n - 1 of input and target, and one of none is left out."""
    return pack_in_order(table(spark, sf_dir, "documents"), 1)


@query(
    "micro_batch_groups",
    """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), g AS (SELECT *, i // 8 AS batch FROM d),
k AS (SELECT batch FROM g GROUP BY batch HAVING count(*) = 8)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(batch % 4 AS INT) AS rank FROM g JOIN k USING (batch)
""",
)
def micro_batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight documents for four ranks in turn; an incomplete group is dropped."""
    g = ordered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumn("batch", F.expr("pos div 8"))
    full = g.groupBy("batch").agg(F.count("*").alias("k")).filter("k = 8").select("batch")
    return g.join(full, "batch").select("doc_id", "batch", F.pmod("batch", F.lit(4)).cast("int").alias("rank"))


@query(
    "loss_by_source",
    """
WITH b AS (SELECT source, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT source, c, count(*) AS n FROM b WHERE c <> '' GROUP BY ALL),
t AS (SELECT c, sum(n) AS n FROM n GROUP BY c), a AS (SELECT sum(n) AS n FROM t)
SELECT n.source, CAST(sum(n.n) AS BIGINT) AS tokens, round(sum(-n.n * ln(t.n / a.n)) / sum(n.n), 6) AS nats, round(sum(-n.n * ln(t.n / a.n)) / sum(n.n) / ln(2), 6) AS bits_per_char FROM n JOIN t USING (c), a GROUP BY n.source
""",
)
def loss_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss of the corpus-wide order-0 model, overall counts against those of each source."""
    from corpusloom.operators.symbols import char_counts

    n = char_counts(table(spark, sf_dir, "documents"), "source")
    t = n.groupBy("c").agg(F.sum("n").alias("t"))
    a = t.agg(F.sum("t").alias("a"))
    loss = n.join(t, "c").crossJoin(a).groupBy("source").agg(F.sum("n").alias("tokens"), F.sum(-F.col("n") * F.ln(F.col("t") / F.col("a"))).alias("s"))  # a is one row
    return loss.select("source", "tokens", F.round(F.col("s") / F.col("tokens"), 6).alias("nats"), F.round(F.col("s") / F.col("tokens") / F.ln(F.lit(2.0)), 6).alias("bits_per_char"))
