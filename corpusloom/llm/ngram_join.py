"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of its 5-word shingles (words as in decontamination;
   fewer than five words make one shingle; no words, no shingles). Texts with equal
   sets form a class, found by a 128-bit hash of the set; one row stands for it.
2. Band and row counts are chosen for the target recall at the threshold. The rows
   of the classes are shuffled on the band hash; a bucket is the classes of one band
   hash, and its candidates are the pairs within it. Of buckets with the same members
   (fingerprints of their keys) one is left, that of the least band.
3. Every pair of a bucket is compared on the full shingle sets, in the bucket of the
   first band that the two share and in no other. A bucket of more than ``block``
   classes is cut into blocks, and each pair of blocks is a task of its own, so no
   task holds more than two blocks. A task counts intersections by inverted lists
   and matrix products and gives one row per class: its links there and the least
   class that it reaches over them, never a row per pair.
4. Connected components of verified links, over a spanning forest of each task's
   links, are the groups of near copies. Candidates that fail never join groups, so
   chance collisions don't chain up.

Joins on a class, a bucket or a group of many rows are split: keys of more than
rows / (4 x partitions) rows, of which there are fewer than 4 x partitions, are
broadcast with what is joined to them, the others shuffled.

Result: one row per document. ``n_links`` counts all other documents at or above the
threshold, copies included; the threshold is compared in whole numbers. Links whose
MinHash bands all differ are missed: with the default target at most one in 10,000 at
the threshold itself, fewer above (at 0.85 less than one in 200,000).

Defined results: a null text has no words; a text without words has no links and is
a class of its own; texts are read whole, however long; repeated rows are copies of each
other; a null id loses against any other as the least of a group; of rows that tie the
group's id is the same; an empty table gives an empty result; extra columns of any name
pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD_ARRAY, SpanHash, batch_sizes, join_skewed, seeded, slices, splitmix, text_bytes
from corpusloom.llm.components import components
from corpusloom.session import materialize

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 120
#: Classes of the least block; blocks grow to eight times this where a bucket is large.
BLOCK = 512


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The (bands, rows) with the fewest false candidates that reach the recall at the threshold."""
    best = None
    for rows in range(1, 13):
        need = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if need * rows <= most and (best is None or rows > best[1]):
            best = (need, rows)
    return best or (most, 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, hasher: SpanHash, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(off) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    word = WORD_ARRAY[data] != 32
    low = WORD_ARRAY[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[off[off < len(data)]] = True
    cut = np.flatnonzero(edge)
    keep = word[cut[:-1]]
    starts, ends = cut[:-1][keep], cut[1:][keep]
    h = splitmix(hasher.spans(hasher.sums(low), starts, ends) + (ends - starts).astype(np.uint64))
    upto = np.searchsorted(starts, off)
    q = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(words)]
    gram = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        gram += h[k : len(h) - words + 1 + k] * q[k]
    gram = splitmix(gram)
    out = []
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            out.append(splitmix(np.array([sum(int(x) * int(y) for x, y in zip(h[a:b], q, strict=False)) % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """MinHash values: minima of the set under multiplications, which permute the 64-bit numbers."""
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 512):
        np.minimum(out, (s[a : a + 512] * mul[:, None]).min(1), out=out)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """A 128-bit hash of each set and its size."""
    h1 = [int(signed(splitmix(s).sum(dtype=np.uint64)[None])[0]) for s in sets]
    h2 = [int(signed(splitmix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None])[0]) for s in sets]
    return [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([len(s) for s in sets], pa.int32())]


def sketches(src: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """id, idh, set hash (two words), number of shingles, band hashes."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, mul = SpanHash(), seeded(bands * rows, 5) | np.uint64(1)
        mix = seeded(rows, 6) | np.uint64(1)
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for i, j in slices(batch_sizes(batch)):
                part = batch.slice(i, j - i)
                sets = shingle_sets(*text_bytes(part.column(2)), hasher, words)
                band = [signed(splitmix((signature(s, mul).reshape(bands, rows) * mix).sum(1, dtype=np.uint64) + number)).tolist() if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *set_hashes(sets), pa.array(band, pa.list_(pa.int64()))], names=["id", "idh", "h1", "h2", "n", "bands"])

    return src.select("id", "idh", "t").mapInArrow(run, f"id {kind}, idh bigint, h1 bigint, h2 bigint, n int, bands array<bigint>")


def intersections(a: list[np.ndarray], b: list[np.ndarray], dense: int = 48) -> np.ndarray:
    """|x & y| for all x of a and y of b. Shingles of many texts go through matrix products, the others through inverted lists."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    both = np.intersect1d(np.unique(flat_a), np.unique(flat_b), assume_unique=True)
    if not len(both):
        return out

    def lists(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        ok = both[at] == flat
        at, row = at[ok], row[ok]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    at_a, row_a = lists(flat_a, row_a)
    at_b, row_b = lists(flat_b, row_b)
    n_a, n_b = np.bincount(at_a, minlength=len(both)), np.bincount(at_b, minlength=len(both))
    common = np.flatnonzero(n_a * n_b > dense * dense)
    where = np.full(len(both), -1)
    where[common] = np.arange(len(common))
    for lo in range(0, len(common), 4096):
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        for m, at, row in ((x, at_a, row_a), (y, at_b, row_b)):
            w = where[at] - lo
            ok = (where[at] >= 0) & (w >= 0) & (w < 4096)
            m[row[ok], w[ok]] = 1.0
        out += x @ y.T
    rare = np.flatnonzero((n_a * n_b <= dense * dense) & (n_a > 0) & (n_b > 0))
    first_a, first_b = np.searchsorted(at_a, np.arange(len(both))), np.searchsorted(at_b, np.arange(len(both)))
    flat = out.reshape(-1)
    for lo, hi in slices(n_a[rare] * n_b[rare], 1 << 20):
        k = rare[lo:hi]
        size = n_a[k] * n_b[k]
        own = np.repeat(k, size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        i = row_a[first_a[own] + step // n_b[own]]
        j = row_b[first_b[own] + step % n_b[own]]
        np.add.at(flat, i * len(b) + j, np.float32(1.0))
    return out


def least_labels(ids_a: np.ndarray, ids_b: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least class that each class of two blocks reaches over the links between them."""
    top = np.iinfo(np.int64).max
    a, b = ids_a, ids_b
    while True:
        b2 = np.minimum(b, np.where(link, a[:, None], top).min(0))
        a2 = np.minimum(a, np.where(link, b2[None, :], top).min(1))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def similar(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """inter / union >= threshold, in whole numbers: the threshold is the nearest fraction p / q."""
    f = Fraction(threshold).limit_denominator(10_000)
    return inter.astype(np.int64) * (f.numerator + f.denominator) >= f.numerator * (size_a[:, None] + size_b[None, :])


def met_before(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share a band before this one."""
    out = np.zeros((len(a), len(b)), bool)
    for k in range(band):
        out |= a[:, k, None] == b[None, :, k]
    return out


#: node, weight, band hashes, shingles
Member = tuple[int, int, np.ndarray, np.ndarray]


def verify(a: list[Member], b: list[Member], band: int, threshold: float) -> pa.RecordBatch:
    """All pairs of two blocks of a bucket, or of one (b empty): links of each class (documents), and the least class that it reaches."""
    same = not b
    b = a if same else b
    ids, weight, bands, size = ([np.array([f(x) for x in s], np.int64) for s in (a, b)] for f in (lambda x: x[0], lambda x: x[1], lambda x: x[2], lambda x: len(x[3])))
    if same and len(a) == 2:
        inter = np.zeros((2, 2), np.float32)
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(a[0][3], a[1][3], assume_unique=True))
    else:
        inter = intersections([x[3] for x in a], [x[3] for x in b])
    link = similar(inter, size[0], size[1], threshold)
    if same:
        np.fill_diagonal(link, False)
    if link.any():
        link &= ~met_before(bands[0], bands[1], band)
    least = least_labels(ids[0], ids[1], link)
    node, links, peer = [ids[0]], [link @ weight[1]], [least[0]]
    if not same:
        node.append(ids[1])
        links.append(link.T @ weight[0])
        peer.append(least[1])
    node, links, peer = (np.concatenate(x) for x in (node, links, peer))
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links, peer)], names=["node", "links", "peer"])


def verify_tasks(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: h, i, j (bucket and its blocks), side, band, node, weight, bands, grams; a task's rows lie next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[Member], list[Member]] = ([], [])
        now = None
        for batch in batches:
            for h, i, j, side, band, node, weight, bands, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, i, j, band) != now and held[0]:
                    yield verify(*held, now[3], threshold)
                if (h, i, j, band) != now:
                    held, now = ([], []), (h, i, j, band)
                held[side].append((node, weight, np.array(bands, np.int64), np.frombuffer(grams, np.uint64)))
        if held[0]:
            yield verify(*held, now[3], threshold)

    return rows.mapInArrow(run, "node bigint, links bigint, peer bigint")


#: Bits of the filter that tells which rows may have candidates; false positives only cost time.
FILTER_BITS = 1 << 25


def row_filter(todo: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter over ``idh``: FILTER_BITS bits however many rows there are."""
    words = todo.selectExpr(f"pmod(idh, {FILTER_BITS}) AS s").selectExpr("s div 64 AS w", "shiftleft(1L, cast(s % 64 AS int)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out


def in_filter(words: np.ndarray, idh: np.ndarray) -> np.ndarray:
    slot = np.mod(idh, FILTER_BITS)
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1


def shingles(src: DataFrame, words: int, keep: np.ndarray) -> DataFrame:
    """idh, h1, h2, n and the shingle set as bytes, of the rows that the filter lets through."""
    known = src.sparkSession.sparkContext.broadcast(keep)  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(known.value, np.asarray(batch.column(0)))))
            for i, j in slices(batch_sizes(batch)):
                part = batch.slice(i, j - i)
                sets = shingle_sets(*text_bytes(part.column(1)), hasher, words)
                yield pa.RecordBatch.from_arrays([part.column(0), *set_hashes(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["idh", "h1", "h2", "n", "grams"])

    return src.select("idh", "t").mapInArrow(run, "idh bigint, h1 bigint, h2 bigint, n int, grams binary")


def blocks_of(size: Column, block: int) -> Column:
    return F.ceil(size / F.least(F.greatest(size / 16, F.lit(block)), F.lit(8 * block))).cast("int")


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of df: id, idh (hash of id and text), key, node (the least key of the equal sets), s (the best row of these), n_links, comp (the least node of the group of near copies), c (the best row of the group)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bands, n_rows = choose_bands(threshold, recall)
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("idh"), F.col(text_col).alias("t"))
    sk = materialize(sketches(src, n_bands, n_rows, words).withColumn("key", F.monotonically_increasing_id()), "sketch")
    some = sk.filter("n > 0")
    cls = materialize(some.groupBy("h1", "h2", "n").agg(F.min("key").alias("node"), F.count("*").alias("weight"), best_of().alias("s")), "classes")

    # buckets with other members than any bucket of a lesser band
    reps = some.select(F.col("key").alias("node"), "idh", "bands").join(cls.select("node", "h1", "h2", "n", "weight"), "node")
    bucket = reps.select("node", F.posexplode("bands").alias("band", "h"))
    sizes = bucket.groupBy("h", "band").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("f1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("f2")).filter("size > 1")
    kept = sizes.groupBy("f1", "f2", "size").agg(F.min(F.struct("band", "h")).alias("w")).select("w.h", "w.band", "size")
    kept = materialize(kept, "buckets")
    todo = join_skewed(bucket, kept, ["h", "band"], "size", cls.count() * n_bands)
    todo = materialize(todo.select("node", "h", "band", "size"), "todo")

    # one shingle set for each class that is in a bucket
    wanted = reps.join(todo.select("node").distinct(), "node", "left_semi").select("node", "idh", "h1", "h2", "n", "weight", "bands")
    wanted = materialize(wanted, "wanted")
    sets = shingles(src, words, row_filter(wanted)).join(wanted, ["idh", "h1", "h2", "n"]).dropDuplicates(["node"]).select("node", "weight", "bands", "grams")
    sets = materialize(sets, "sets")

    n_blocks = blocks_of(F.col("size"), block)
    pairs = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    tasks = todo.withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).select("node", "h", "band", "own", F.explode(pairs).alias("p"))
    tasks = tasks.select("node", "h", "band", "p.i", "p.j", F.when(F.col("p.i") == F.col("own"), 0).otherwise(1).alias("side"))
    tasks = tasks.join(sets, "node").select("h", "i", "j", "side", "band", "node", "weight", "bands", "grams")
    found = materialize(verify_tasks(tasks.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "band"), threshold), "found")
    comp = components(found.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))

    cls = cls.join(links, "node", "left").join(comp, "node", "left")
    cls = cls.select("h1", "h2", "n", "node", "weight", "s", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    cls = materialize(cls, "linked")
    comps = cls.groupBy("comp").agg(F.count("*").alias("size"), F.min("s").alias("c"))
    cls = materialize(join_skewed(cls, comps, ["comp"], "size", cls.count()), "grouped")
    rows = join_skewed(some.select("id", "idh", "key", "h1", "h2", "n"), cls, ["h1", "h2", "n"], "weight", some.count())
    rows = rows.select("id", "idh", "key", "node", "s", "n_links", "comp", "c")
    alone = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    blank = sk.filter("n = 0").select("id", "idh", "key", F.col("key").alias("node"), alone.alias("s"), F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("comp"), alone.alias("c"))
    return rows.unionByName(blank)


def best_of() -> Column:
    """The row with the least id; nulls come last."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key")))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """One row per document: id, class_id and set_id (the least document id of the near copies and of the equal shingle sets), n_links."""
    rows = near_links(df, id_col, text_col, **how)
    return rows.select(F.col("id").alias(id_col), F.col("c.id").alias("class_id"), F.col("s.id").alias("set_id"), "n_links")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of df without all but one (the least id) of each group of near copies; rows alike in id and text count as one."""
    rows = materialize(near_links(df, id_col, text_col, **how), "near")
    lose = rows.filter(F.col("key") != F.col("c.key")).select("idh")
    stay = rows.filter(F.col("key") == F.col("c.key")).select("idh")
    lose = lose.distinct().join(stay, "idh", "left_anti")
    out = df.withColumn("__idh", F.xxhash64(F.col(id_col), F.col(text_col))).join(lose.withColumnRenamed("idh", "__idh"), "__idh", "left_anti")
    order = Window.partitionBy("__idh").orderBy(F.lit(1))
    return out.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").select(*df.columns)
