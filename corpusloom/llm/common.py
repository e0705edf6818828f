"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship

#: Bytes of text that one numpy step handles at once; longer texts are handled alone.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def learn_rows(doc_id: str | Column, mod: int, held: int, want_held: bool = False) -> Column:
    """crc32(doc_id as text) mod ``mod`` is not ``held`` (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    r = F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "utf-8")) % mod
    return (r == held) if want_held else (r != held)


def slices(lengths: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` in sum, or of one row."""
    ends = np.cumsum(lengths)
    i, n = 0, len(lengths)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, j
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its row offsets; null counts as empty."""
    a = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(a.type):
        a = a.cast(pa.string())
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches that are cut so that each holds few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch_sizes(batch), 8 << 20):
                out = fn(batch.slice(i, j - i))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def batch_sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's text columns."""
    n = np.full(batch.num_rows, 16, np.int64)
    for k, f in enumerate(batch.schema):
        if pa.types.is_string(f.type) or pa.types.is_binary(f.type):
            n += np.asarray(pc.fill_null(pc.binary_length(batch.column(k)), 0), dtype=np.int64)
    return n


def text_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, and a few more for the row."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 16


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n 64-bit words from a seed, the same in every process."""
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))


#: Word bytes: digits, a-z and all bytes of non-ASCII characters; A-Z become a-z, the rest blanks.
WORD_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
WORD_ARRAY = np.frombuffer(WORD_TABLE, np.uint8)


def bounded_sample(df: DataFrame, group: str, bound: int, seed: int = 7) -> DataFrame:
    """Distinct rows, chosen by a hash of the row: all of a value of ``group`` that has at most ``bound`` rows, else each with probability bound / rows.

    The number chosen is binomial with mean ``bound`` at most. Rows that are alike are
    chosen together and count once, so a value with many copies gives fewer. Two scans
    serve all groups; only chosen rows are shuffled.
    """
    n = df.groupBy(group).agg(F.count("*").alias("__n"))
    h = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != group], F.lit(seed)), F.lit(1 << 40))
    limit = F.least(F.lit(float(1 << 40)), F.lit(float(1 << 40)) * bound / F.col("__n"))
    # one row per group: labels or languages
    some = df.join(F.broadcast(n.withColumnRenamed(group, "__g")), F.col(group).eqNullSafe(F.col("__g"))).filter(h < limit)
    return some.select(*df.columns).distinct()


def one_text(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each id of ``ids`` (few distinct ones, broadcast) the least text, null as empty. A repeated id is reduced before the shuffle."""
    rows = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids.select(F.col(id_col).alias("i")).distinct()), "i", "left_semi")
    return rows.groupBy("i").agg(F.min("t").alias("t"))


def join_skewed(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with ``keyed``, which has one row per key and in ``count`` the rows of it; ``total`` is their sum.

    Keys of more than total / (4 x partitions) rows come to the driver (there are fewer
    than 4 x partitions of them) and are broadcast; the others are shuffled. Without
    such keys it is a plain join.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(64, total // (4 * parts))
    hot = keyed.filter(F.col(count) > limit).collect()
    if not hot:
        return rows.join(keyed, keys)
    hot = F.broadcast(spark.createDataFrame(hot, keyed.schema))
    cold = keyed.filter(F.col(count) <= limit)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def carried(row: str, carry: list[str], results: tuple[str, ...]) -> list[Column]:
    """The carried fields of the struct ``row`` in order; one that has the name of a result gets ``_in`` behind it until it has a name of its own."""
    taken = {x.lower() for x in results} | {c.lower() for c in carry if c.lower() not in {x.lower() for x in results}}
    out = []
    for c in carry:
        name = c
        if c.lower() in {x.lower() for x in results}:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out.append(F.col(row).getField(c).alias(name))
    return out


class SpanHash:
    """64-bit polynomial hashes of byte spans: T[b0] + T[b1] p + T[b2] p^2 ..., with the words of a seeded table."""

    def __init__(self, seed: int = 11) -> None:
        self.table = seeded(256, seed)
        self.p = int(seeded(1, seed + 1)[0]) | 1
        self.q = pow(self.p, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one more than there are bytes."""
        n = len(data)
        self.up = self._grow(self.up, self.p, n + 1)
        self.down = self._grow(self.down, self.q, n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]


def row_and_text(df: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """(__row, __text): the carried columns as a struct, and the text unless the struct holds it."""
    text = F.lit(None).cast("string") if text_col in carry else F.col(text_col)
    return df.select(F.struct(*[F.col(c) for c in carry]).alias("__row"), text.alias("__text"))


def texts_of(batch: pa.RecordBatch, carry: list[str], text_col: str) -> pa.Array:
    """The texts of a batch of ``row_and_text``."""
    return batch.column(0).field(carry.index(text_col)) if text_col in carry else batch.column(1)
