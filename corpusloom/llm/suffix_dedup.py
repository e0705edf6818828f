"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

A full suffix array of a corpus is out of reach of the stated limits (a first level
of sampled triples alone holds two rows for every three bytes of text), so the
difference-cover sort runs on what may repeat at all, and a content-defined sample
finds that:

1. Anchors. Of each window of ``width`` bytes the ``gram``-byte string with the least
   hash is its anchor. Equal windows have equal anchors at equal offsets, so a sample
   of about two in ``width - gram`` positions stands for all windows, as the sampled
   positions of a difference cover do. Windows of one anchor are consecutive: the
   anchor's range.
2. Anchors that occur once can't repeat. Their hashes, counted before they are shuffled
   and kept as packed arrays, pass into a bit filter of bounded size; what it lets
   through goes on. A second filter tells the anchors of ``hot`` places or more, whose
   rows are dealt by document as well.
3. Places are sorted by anchor and range. Ranges that are equal as a whole lie next to
   each other: all windows of all but the first repeat; these need no sorting, however
   many copies there are. They are equal by the anchor's hash and by that of the range
   and the anchor's place in it, 64 bits each; their bytes aren't compared, because the
   texts of all copies would have to be shuffled for it.
4. The first places of different ranges that share an anchor go to one task as byte
   strings. Windows whose hash occurs once there are cut off; of what is left the
   difference-cover algorithm sorts the suffixes: sampled triples are sorted and named,
   names are sorted recursively, the remaining suffixes are merged in, and adjacent
   prefixes of ``width`` bytes are compared byte by byte. Of equal windows all but the
   earliest repeat. An anchor with more than ``most`` such places is dealt by the hash
   of each window instead: windows that are equal (byte by byte) are reduced to the
   earliest before the shuffle, and met in order of place after it.
5. The repeated windows of each document are merged and cut out. Documents that have
   none by a third filter aren't shuffled.

Documents are ordered by id (nulls last), then by a hash of the text; rows alike in
id and text are the same document and get the same result. A null text counts as
empty; texts shorter than ``width`` are kept whole, very long ones are read in parts
that overlap; an empty table gives an empty result; a carried column that has the name
of a result is renamed (see ``carried``), other extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SpanHash, batch_sizes, carried, slices, splitmix, text_bytes
from corpusloom.session import materialize

WIDTH = 100
GRAM = 32
#: First places of one anchor that are sorted together.
MOST = 1_500
#: Places of an anchor from which on they are dealt by document as well.
HOT = 4_096


@dataclass
class Anchors:
    """Anchors of a batch: row, place in the text, first and last window, hash of the gram, hash of the range."""

    row: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    range_hash: np.ndarray


#: Bytes of a step.
STEP = 1 << 19
#: Bits of a place within a step; the other bits of a word hold the hash.
PLACE_BITS = 24


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the least one, the first of equals (of 40-bit values)."""
    bits = np.uint64(PLACE_BITS)
    low = ((x >> bits) << bits) | np.arange(len(x), dtype=np.uint64)
    n = len(x) - w + 1
    have = 1
    while have * 2 <= w:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[:n], low[w - have : w - have + n])
    return (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def steps(data: np.ndarray, off: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, offsets): texts together up to a limit; a very long one in parts that share width - 1 bytes."""
    part = 8 << 20
    for i, j in slices(np.diff(off), STEP):
        a, b = int(off[i]), int(off[j])
        if b - a <= part:
            yield i, 0, data[a:b], off[i : j + 1] - a
            continue
        for c in range(a, b - width + 1, part):
            d = min(b, c + part + width - 1)
            yield i, c - a, data[c:d], np.array([0, d - c], np.int64)


def anchors(data: np.ndarray, off: np.ndarray, hasher: SpanHash, width: int = WIDTH, gram: int = GRAM) -> Anchors | None:
    """Anchors of all texts of a batch."""
    n = len(data)
    if n < width:
        return None
    sums = hasher.sums(data)
    up = hasher.down[: n - gram + 1]
    h = (sums[gram:] - sums[: n - gram + 1]) * up
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    w = width - gram + 1
    best = sliding_argmin(h, w)
    size = np.diff(off)
    row_of = np.repeat(np.arange(len(size)), size)[: len(best)]
    ok = np.arange(len(best)) + width <= off[1:][row_of]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | ~ok[:-1] | (row_of[1:] != row_of[:-1])
    new &= ok
    lo = np.flatnonzero(new)
    if not len(lo):
        return None
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
    row = row_of[lo]
    at = best[lo]
    span = hasher.spans(sums, lo, stop + width)
    sig = splitmix(span + ((stop - lo) * 256 + at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Anchors(row, at - off[row], lo - off[row], stop - off[row], h[at], sig)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Difference-cover sort of all suffixes of an array of numbers >= 0."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    base = int(s.max()) + 2
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(4, np.int64)])
    pos = np.arange(n + (n % 3 == 1))  # one more triple of padding, so that the last suffix of the first kind ends in it
    one, two = pos[pos % 3 == 1], pos[pos % 3 == 2]
    sample = np.concatenate([one, two])
    if base < 2_000_000:
        triple = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    else:
        _, pair = np.unique(t[sample] * base + t[sample + 1], return_inverse=True)
        triple = pair * base + t[sample + 2]
    names, name = np.unique(triple, return_inverse=True)
    if len(names) < len(sample):
        # names of the first kind, then of the second; the padding triple ends the first part
        order = suffix_array(name)
    else:
        order = np.argsort(name, kind="stable")
    sorted_sample = sample[order]
    rank = np.zeros(n + 5, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    # the remaining suffixes, by first number and the rank of what follows
    zero = pos[(pos % 3 == 0) & (pos < n)]
    m = len(sample) + 2
    zero = zero[np.argsort(t[zero] * m + rank[zero + 1], kind="stable")]
    first = sorted_sample[sorted_sample % 3 == 1]
    second = sorted_sample[sorted_sample % 3 == 2]
    before1 = np.searchsorted(t[first] * m + rank[first + 1], t[zero] * m + rank[zero + 1])
    pair2, pair0 = t[second] * base + t[second + 1], t[zero] * base + t[zero + 1]
    if base * base * m >= 1 << 62:
        # two numbers and a rank don't fit a word: name the pairs first
        _, pair = np.unique(np.concatenate([pair2, pair0]), return_inverse=True)
        pair2, pair0 = pair[: len(second)], pair[len(second) :]
    before2 = np.searchsorted(pair2 * m + rank[second + 2], pair0 * m + rank[zero + 2])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + before1 + before2] = zero
    out[out < 0] = sorted_sample
    return out


def repeated_starts(contexts: list[bytes], windows: np.ndarray, order: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) pairs whose ``width`` bytes also start earlier in another or the same context.

    ``windows``: windows of each context; ``order``: rank of (context start) among all
    contexts, windows of a context rank by their place.
    """
    size = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(contexts)), windows)
    step = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = begin[own] + step
    valid = np.full(len(flat), -1, np.int64)
    valid[start] = np.arange(len(start))
    sa = suffix_array(flat)
    at = valid[sa]
    at = at[at >= 0]
    places = start[at]
    same = np.zeros(len(at), bool)
    offsets = np.arange(width)
    for lo in range(1, len(at), 20_000):
        hi = min(len(at), lo + 20_000)
        a, b = places[lo - 1 : hi - 1], places[lo:hi]
        same[lo:hi] = (flat[a[:, None] + offsets] == flat[b[:, None] + offsets]).all(1)
    group = np.cumsum(~same)
    rank = order[own[at]] * 256 + step[at]
    by = np.lexsort((rank, group))
    later = np.ones(len(at), bool)
    later[by[np.concatenate([[True], group[by][1:] != group[by][:-1]])]] = False
    hit = at[later]
    return own[hit], step[hit]


#: Bits of the filter over anchors that occur more than once: by the input, within these bounds.
LEAST_BITS, MOST_BITS = 22, 28


@dataclass
class BitFilter:
    """One bit per leading bits of a hash."""

    bits: int
    words: np.ndarray  # uint8

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pack_bits(slots: np.ndarray, n: int) -> bytes:
    out = np.zeros(n, np.uint8)
    out[slots] = 1
    return np.packbits(out, bitorder="little").tobytes()


def gather_filters(packed: DataFrame, bits: int, bucket_bits: int, least: tuple[int, ...]) -> list[BitFilter]:
    """Filters of 2^bits bits, which MOST_BITS bounds; they are broadcast."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, (1 << bits) >> bucket_bits >> 3)
    out = [BitFilter(bits, np.zeros((1 << bits) // 8, np.uint8)) for _ in least]
    for r in by_bucket(packed, parts, bits, bucket_bits, least).toLocalIterator():
        out[r.k].words[r.bucket * size : (r.bucket + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out


def by_bucket(packed: DataFrame, parts: int, bits: int, bucket_bits: int, least: tuple[int, ...]) -> DataFrame:
    """From (bucket, distinct 32-bit words, counts above one) the filter ranges of the words that occur at least so often, for each of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        more: list[bytes] = []
        now = None

        def close() -> pa.RecordBatch:
            rest, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
            extra = np.frombuffer(b"".join(more), np.uint32).reshape(-1, 2)
            n = n + np.bincount(np.searchsorted(rest, extra[:, 0]), weights=extra[:, 1], minlength=len(rest)).astype(np.int64)
            width = bits - bucket_bits
            bit_rows = [pack_bits(rest[n >= x] >> np.uint32(32 - width), 1 << width) for x in least]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(least), pa.int32()), pa.array(range(len(least)), pa.int32()), pa.array(bit_rows, pa.binary())], names=["bucket", "k", "bits"])

        for batch in batches:
            for b, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now and held:
                    yield close()
                    held, more = [], []
                now = b
                held.append(words)
                more.append(counts)
        if held:
            yield close()

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, k int, bits binary")


def deal(h: np.ndarray, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Pack hashes by their leading bits: bucket, the next 32 bits of each distinct one, and (32 bits, further occurrences) of those that occur again."""
    h = np.sort(h >> np.uint64(32 - bucket_bits))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(first, len(h)))
    h = h[first]
    bucket = (h >> np.uint64(32)).astype(np.int64)
    rest = h.astype(np.uint32)  # the lower 32 bits
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cut[1:], len(h))
    again = np.flatnonzero(n > 1)
    pairs = np.column_stack([rest[again], np.minimum(n[again] - 1, 1 << 30).astype(np.uint32)])
    raw, raw_again = rest.tobytes(), pairs.tobytes()
    lo, hi = np.searchsorted(again, cut), np.searchsorted(again, ends)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array([raw[4 * a : 4 * b] for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([raw_again[8 * a : 8 * b] for a, b in zip(lo, hi, strict=True)], pa.binary())], names=["bucket", "words", "counts"])


def mix_place(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of (document hash, place)."""
    return splitmix(doc.astype(np.int64).view(np.uint64) + splitmix(lo.astype(np.uint64) + np.uint64(1)))


def packer(column: int, bucket_bits: int, hashes) -> Callable:  # noqa: ANN001
    """A mapInArrow function that packs what ``hashes(batch)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i, j in slices(batch_sizes(batch), 4 << 20):
                for h in hashes(batch.slice(i, j - i)):
                    held.append(h)
                    n += len(h)
                if n >= 1 << 19:
                    yield from deal(np.concatenate(held), bucket_bits)
                    held, n = [], 0
        if n:
            yield from deal(np.concatenate(held), bucket_bits)

    return run


PACKED = "bucket int, words binary, counts binary"


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: the id) with n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets)."""
    spark = df.sparkSession
    carry = [id_col] if carry is None else carry
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc")
    src = df.select(F.col(id_col).alias("id"), doc, F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    n_anchors = 2 * (src.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // (width - gram)
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * n_anchors).bit_length()))
    bucket_bits = min(bits - 3, max(8, (n_anchors >> 14).bit_length()))

    def scan(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Anchors]]:
        data, off = text_bytes(column)
        for row, place, part, part_off in steps(data, off, width):
            a = anchors(part, part_off, HASHER, width, gram)
            if a is not None:
                yield row, place, part, part_off, a

    # anchors that occur more than once, and often
    packed = src.select("t").mapInArrow(packer(0, bucket_bits, lambda batch: (a.gram for *_, a in scan(batch.column(0)))), PACKED)
    again, often = (spark.sparkContext.broadcast(x) for x in gather_filters(packed, bits, bucket_bits, (2, hot)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch_sizes(batch), 4 << 20):
                part = batch.slice(i, j - i)
                docs = np.asarray(part.column(1))
                for row, place, _, _, a in scan(part.column(2)):
                    k = np.flatnonzero(again.value.has(a.gram))
                    if not len(k):
                        continue
                    at = row + a.row[k]
                    salt = np.where(often.value.has(a.gram[k]), 1 + np.mod(docs[at], parts), 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(docs[at]), pa.array((place + a.lo[k]).astype(np.int32)), pa.array((a.hi - a.lo)[k].astype(np.int16)), pa.array(a.gram[k].view(np.int64)), pa.array(a.range_hash[k].view(np.int64)), pa.array(salt)], names=["id", "doc", "lo", "n", "g", "sig", "salt"])

    # places are below 2^31 because a Spark string is
    occ = src.mapInArrow(places, f"id {kind}, doc bigint, lo int, n smallint, g bigint, sig bigint, salt int")
    occ = occ.repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "sig", F.col("id").asc_nulls_last(), "doc", "lo")
    found = materialize(occ.mapInArrow(lambda it: first_places(it, width), f"first boolean, id {kind}, doc bigint, a int, b int, g bigint"), "places")
    copies = found.filter("NOT first").select("id", "doc", "a", "b")
    firsts = found.filter("first").select("doc", "a", "g")

    # the strings of first places
    def mark(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix_place(np.asarray(batch.column(0)), np.asarray(batch.column(1)))

    def own(column: int) -> Callable:
        return lambda batch: iter([splitmix(np.asarray(batch.column(column)).view(np.uint64))])

    def raw_gram(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.asarray(batch.column(2)).view(np.uint64)

    gather = lambda df, hashes, least: [spark.sparkContext.broadcast(x) for x in gather_filters(df.mapInArrow(packer(0, bucket_bits, hashes), PACKED), bits, bucket_bits, least)]
    (wanted,) = gather(firsts, mark, (1,))
    (has_first,) = gather(firsts, own(0), (1,))
    (crowded,) = gather(firsts, raw_gram, (most,))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = has_first.value.has(splitmix(np.asarray(batch.column(1)).view(np.uint64)))
            batch = batch.filter(pa.array(keep))
            for i, j in slices(batch_sizes(batch), 4 << 20):
                part = batch.slice(i, j - i)
                docs = np.asarray(part.column(1))
                for row, place, data, off, a in scan(part.column(2)):
                    k = np.flatnonzero(wanted.value.has(mix_place(docs[row + a.row], place + a.lo)))
                    if len(k):
                        yield cut_strings(part, row, place, data, off, a, k, crowded.value.has(a.gram[k]), width, parts)

    ctx = src.mapInArrow(strings, f"id {kind}, doc bigint, lo int, g bigint, salt int, s binary, m int")
    ctx = ctx.repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", F.col("id").asc_nulls_last(), "doc", "lo")
    ragged = materialize(ctx.mapInArrow(lambda it: sort_strings(it, width), f"id {kind}, doc bigint, a int, b int"), "ragged")

    spans = copies.unionByName(ragged)
    (cut,) = gather(spans.select("doc", "a"), own(0), (1,))
    spans = spans.groupBy("id", "doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "id2", "doc": "doc2"})
    whole = df.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(id_col).alias("id"), doc, F.col(text_col).alias("t"))

    def part_of(inside: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(cut.value.has(splitmix(np.asarray(batch.column(2)).view(np.uint64))) == inside))

        return run

    runs = "array<struct<a:bigint,b:bigint>>"
    result = f"row {whole.schema['row'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed {runs}"
    touched = whole.mapInArrow(part_of(True), whole.schema).join(spans, F.col("id").eqNullSafe(F.col("id2")) & (F.col("doc") == F.col("doc2")), "left").select("row", "t", "spans")
    clean = whole.mapInArrow(part_of(False), whole.schema).select("row", "t", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    got = touched.mapInArrow(cut_out, result).unionByName(clean.mapInArrow(cut_out, result))
    return got.select(*carried("row", carry, ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


HASHER = SpanHash()


def first_places(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Places sorted by (g, salt, sig, id, doc, lo): those whose range occurs before, as (a, b), and the first ones of anchors with several ranges.

    What is held from batch to batch is the last row, and the first place of the open
    anchor while that has one range only.
    """
    last: tuple | None = None
    open_first: pa.RecordBatch | None = None

    def rows(batch: pa.RecordBatch, k: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        part = batch.take(pa.array(k))
        lo, n = np.asarray(part.column(2)).astype(np.int32), np.asarray(part.column(3))
        return pa.RecordBatch.from_arrays([pa.array(first), part.column(0), part.column(1), pa.array(lo), pa.array((lo + n + width).astype(np.int32)), part.column(4)], names=["first", "id", "doc", "a", "b", "g"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, lo, g, sig, salt = (np.asarray(batch.column(k)) for k in (1, 2, 4, 5, 6))
        keys = (g, salt, sig, doc, lo)
        differs = [np.concatenate([[last is None or x[0] != last[k]], x[1:] != x[:-1]]) for k, x in enumerate(keys)]
        new_g = differs[0] | differs[1]
        new = new_g | differs[2]
        again = ~new & ~differs[3] & ~differs[4]
        group = np.cumsum(new_g)  # 0 is the anchor that was open before
        n_new = np.bincount(group, weights=new, minlength=int(group[-1]) + 1)
        several = n_new > 1
        several[0] = n_new[0] > 0
        if open_first is not None and several[0]:
            yield open_first
        if several[0] or group[-1] > 0:
            open_first = None
        emit = new & (several[group] | (salt > 0))
        keep = np.flatnonzero((~new & ~again) | emit)
        if len(keep):
            yield rows(batch, keep, new[keep])
        # the last anchor goes on: its only range so far may get company
        if group[-1] > 0 and n_new[-1] == 1 and salt[-1] == 0:
            at = np.flatnonzero(new_g)[-1:]
            open_first = rows(batch, at, np.array([True]))
        last = tuple(x[-1] for x in keys)


def cut_strings(part: pa.RecordBatch, row: int, place: int, data: np.ndarray, off: np.ndarray, a: Anchors, k: np.ndarray, crowded: np.ndarray, width: int, salts: int) -> pa.RecordBatch:
    """The ranges of places k as strings (m = 0); of crowded anchors the windows, dealt by their hash: the earliest of equal ones as a string, the others as repeats (m = width)."""
    raw = data.tobytes()
    at = row + a.row[k]
    begin = off[a.row[k]] + a.lo[k]
    size = (a.hi - a.lo)[k] + 1
    lo = place + a.lo[k]
    one = np.flatnonzero(~crowded)
    many = np.repeat(np.flatnonzero(crowded), size[crowded])
    step = np.arange(len(many)) - np.repeat(np.cumsum(size[crowded]) - size[crowded], size[crowded])
    pick = np.concatenate([one, many])
    shift = np.concatenate([np.zeros(len(one), np.int64), step])
    x = begin[pick] + shift
    y = x + np.concatenate([size[one] - 1, np.zeros(len(many), np.int64)]) + width
    salt, m = np.zeros(len(pick), np.int32), np.zeros(len(pick), np.int32)
    if len(many):
        start = x[len(one) :]
        h = splitmix(HASHER.spans(HASHER.sums(data), start, start + width))
        salt[len(one) :] = 1 + (h % np.uint64(salts)).astype(np.int32)
        order = ranks(part)
        doc, spot = order[at[many]], lo[many] + step
        by = np.lexsort((spot, doc, h))
        first = np.concatenate([[True], h[by][1:] != h[by][:-1]])
        head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        for i in range(0, len(by), 20_000):
            u, v = start[by[i : i + 20_000]], start[head[i : i + 20_000]]
            same = (data[u[:, None] + np.arange(width)] == data[v[:, None] + np.arange(width)]).all(1)
            # a row that is repeated has the same place, which is no repeat
            p, q = by[i : i + 20_000], head[i : i + 20_000]
            m[len(one) + p[same & ((doc[p] != doc[q]) | (spot[p] != spot[q]))]] = width
    rows = pa.array(at[pick])
    strings = [b"" if z else raw[i:j] for i, j, z in zip(x.tolist(), y.tolist(), m.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array((lo[pick] + shift).astype(np.int32)), pa.array(a.gram[k][pick].view(np.int64)), pa.array(np.where(m > 0, -1 - pick % salts, salt).astype(np.int32)), pa.array(strings, pa.binary()), pa.array(m)], names=["id", "doc", "lo", "g", "salt", "s", "m"])


def ranks(part: pa.RecordBatch) -> np.ndarray:
    """The place of each row in the order of documents; rows of one document have the same."""
    keys = [(i is None, 0 if i is None else i, d) for i, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
    number = {k: n for n, k in enumerate(sorted(set(keys)))}
    return np.array([number[k] for k in keys], np.int64)


def repeated_parts(contexts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose hash occurs again among all contexts: context, first window, windows."""
    size = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    windows = size - width + 1
    own = np.repeat(np.arange(len(contexts)), windows)
    step = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (np.cumsum(size) - size)[own] + step
    h = HASHER.spans(HASHER.sums(flat), start, start + width)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    k = np.flatnonzero(again)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1] + 1) | (own[k[1:]] != own[k[:-1]])
    first = np.flatnonzero(new)
    return own[k[first]], step[k[first]], np.diff(np.append(first, len(k)))


def sort_strings(batches: Iterator[pa.RecordBatch], width: int, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(id, doc, lo, g, salt, s, m), sorted by (g, salt, id, doc, lo): the repeated runs of windows.

    Strings of one anchor are sorted together. The windows of a crowded anchor
    (salt > 0) come in order of place, so each is a repeat if it was met before; only
    distinct ones are held. Known repeats (salt < 0) pass.
    """
    held: list[tuple] = []
    seen: set[bytes] = set()
    size, now, last = 0, None, None
    id_type = None

    def spans(who: list[tuple], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in who], id_type), pa.array([x[1] for x in who], pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["id", "doc", "a", "b"])

    def close() -> pa.RecordBatch:
        own, begin, n = repeated_parts([x[3] for x in held], width)
        parts = [held[k][3][a : a + m + width - 1] for k, a, m in zip(own.tolist(), begin.tolist(), n.tolist(), strict=True)]
        if not parts:
            return spans([], own, own)
        part, step = repeated_starts(parts, n, np.arange(len(parts)), width)
        by = np.lexsort((step, part))
        part, step = part[by], step[by]
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(part)) - 1
        which = own[part[first]]
        lo = np.array([held[k][2] for k in which.tolist()], np.int64) + begin[part[first]]
        return spans([held[k] for k in which.tolist()], lo + step[first], lo + step[end[: len(first)]] + width)

    for batch in batches:
        id_type = batch.column(0).type
        out = []
        for i, d, lo, g, salt, s, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (g, salt) != now:
                seen = set()
                if size > limit:
                    yield close()
                    held, size = [], 0
            if (g, salt, i, d, lo) == last:
                continue  # the same document again
            now, last = (g, salt), (g, salt, i, d, lo)
            if salt == 0:
                held.append((i, d, lo, s))
                size += len(s)
            elif m or s in seen:
                out.append((i, d, lo))
            else:
                seen.add(s)
        if out:
            lo = np.array([x[2] for x in out], np.int64)
            yield spans(out, lo, lo + width)
    if held:
        yield close()


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, spans): what is left of each text."""
    runs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        n_bytes, n_removed, n_spans, sha, out = [], [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            left, at = hashlib.sha256(), 0
            for a, b in merged:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(sum(b - a for a, b in merged))
            n_spans.append(len(merged))
            sha.append(left.hexdigest())
            out.append([{"a": a, "b": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(out, runs)], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
