"""A lossless coder for each document: binary arithmetic coding of an adaptive order-1 bit model.

The decoder runs the same model on what it has decoded. All arithmetic is on
integers, so both sides agree to the bit. The unit of work is a document; state
never crosses documents. ``encode`` and ``decode`` say what a code is; ``encode_many``
and ``decode_many`` make and read the same codes, a step of many documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

ONE = 1 << 16
TOP = (1 << 32) - 1
RATE = 4


class BitModel:
    """P(next bit is 1) in 1/65536 by (byte before, bits so far)."""

    def __init__(self) -> None:
        self.p: dict[int, int] = {}

    def get(self, key: int) -> int:
        return self.p.get(key, ONE // 2)

    def update(self, key: int, p: int, bit: int) -> None:
        self.p[key] = p + ((ONE - p) >> RATE) if bit else p - (p >> RATE)


def split_point(low: int, high: int, p: int) -> int:
    """Where the interval parts: ones take the lower share."""
    p = min(ONE - 32, max(32, p))
    return low + ((high - low) * p >> 16)


def encode(raw: bytes, model: BitModel | None = None, state: tuple[int, int, int] = (0, TOP, 0), out: bytearray | None = None) -> bytes:
    """The code of a text, or of what follows after a state (low, high, byte before)."""
    model, out = model or BitModel(), bytearray() if out is None else out
    low, high, before = state
    for byte in raw:
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            key = before << 8 | node
            p = model.get(key)
            mid = split_point(low, high, p)
            if bit:
                high = mid
            else:
                low = mid + 1
            model.update(key, p, bit)
            node = node << 1 | bit
            while (low ^ high) >> 24 == 0:
                out.append(high >> 24)
                low, high = low << 8 & TOP, (high << 8 & TOP) | 255
        before = byte
    if raw:
        out += ending(low, high)
    return bytes(out)


def ending(low: int, high: int) -> bytes:
    return (low + 1 if low < high else low).to_bytes(4, "big")


def decode(code: bytes, n: int, model: BitModel | None = None, state: tuple[int, int, int, int, int] | None = None) -> bytes:
    """n bytes of a code, from its beginning or after a state (low, high, byte before, bits read, place)."""
    model, out = model or BitModel(), bytearray()
    low, high, before, x, at = state or (0, TOP, 0, int.from_bytes(code[:4].ljust(4, b"\0"), "big"), 4)
    for _ in range(n):
        node = 1
        for _ in range(8):
            key = before << 8 | node
            p = model.get(key)
            mid = split_point(low, high, p)
            bit = int(x <= mid)
            if bit:
                high = mid
            else:
                low = mid + 1
            model.update(key, p, bit)
            node = node << 1 | bit
            while (low ^ high) >> 24 == 0:
                low, high = low << 8 & TOP, (high << 8 & TOP) | 255
                x = (x << 8 & TOP) | (code[at] if at < len(code) else 0)
                at += 1
        before = node & 255
        out.append(before)
    return bytes(out)


#: Documents that are coded side by side; with so few left, one by one is faster.
LANES, FEW = 1024, 12
#: Probabilities after a 0 and after a 1, and as the interval takes them.
NEXT = np.array([[p - (p >> RATE) for p in range(ONE)], [p + ((ONE - p) >> RATE) for p in range(ONE)]]).astype(np.uint16).ravel()
SHARE = np.clip(np.arange(ONE), 32, ONE - 32)
#: Keys of the eight bits of a byte.
NODES = np.array([[1 << k | byte >> 8 - k for byte in range(256)] for k in range(8)])
BITS = np.array([[byte >> 7 - k & 1 for byte in range(256)] for k in range(8)])


class Lanes:
    """Documents side by side, the longest first; where one ends, the next begins. A lane has an interval and a model."""

    def __init__(self, sizes: list[int]) -> None:
        self.sizes = np.array(sizes, np.int64)
        order = np.argsort(-self.sizes, kind="stable")
        self.waiting = order[self.sizes[order] > 0].tolist()[::-1]
        n = min(LANES, len(self.waiting))
        self.model = np.full((n, ONE), ONE // 2, np.uint16)
        self.flat = self.model.reshape(-1)
        self.doc, self.low, self.high, self.before, self.left = np.zeros((5, n), np.int64)
        self.lane = np.arange(n)  # rows of the model
        for k in range(n):
            self.begin(k)

    def begin(self, k: int) -> None:
        d = self.doc[k] = self.waiting.pop()
        self.low[k], self.high[k], self.before[k], self.left[k] = 0, TOP, 0, self.sizes[d]
        self.model[self.lane[k]] = ONE // 2

    def known(self, k: int) -> BitModel:
        m = BitModel()
        m.p = dict(enumerate(self.model[self.lane[k]].tolist()))
        return m

    def keep(self, stay: np.ndarray) -> None:
        for name in ("doc", "low", "high", "before", "left", "lane"):
            setattr(self, name, getattr(self, name)[stay])


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes


def encode_many(texts: list[bytes]) -> list[bytes]:
    """The codes of ``encode``."""
    out: list[bytes] = [b""] * len(texts)
    lanes = Lanes([len(t) for t in texts])
    src, begin = np.frombuffer(b"".join(texts), np.uint8), starts(lanes.sizes)
    # a code is longer than its text by few bytes; one that needs more room is made anew alone
    room = lanes.sizes + (lanes.sizes >> 2) + 64
    put, dest = np.zeros(int(room.sum()), np.uint8), starts(room)
    fill = dest[lanes.doc]
    while len(lanes.doc) > FEW:
        low, high, doc = lanes.low, lanes.high, lanes.doc
        byte = src[begin[doc] + lanes.sizes[doc] - lanes.left].astype(np.int64)
        at = (lanes.lane << 16 | lanes.before << 8) + NODES[:, byte]
        p, bits = lanes.flat[at], BITS[:, byte]
        lanes.flat[at] = NEXT[(bits << 16) + p]
        share, ones = SHARE[p], bits.astype(bool)
        for k in range(8):
            mid = low + ((high - low) * share[k] >> 16)
            low, high = np.where(ones[k], low, mid + 1), np.where(ones[k], mid, high)
            same = np.flatnonzero((low ^ high) < 1 << 24)
            while len(same):
                a, b = low[same], high[same]
                put[fill[same]] = b >> 24
                fill[same] += 1
                a, b = a << 8 & TOP, b << 8 & TOP | 255
                low[same], high[same] = a, b
                same = same[(a ^ b) < 1 << 24]
        lanes.low, lanes.high, lanes.before = low, high, byte
        lanes.left -= 1
        over = fill - dest[doc] > room[doc] - 40
        ended = np.flatnonzero((lanes.left == 0) | over)
        for k in ended.tolist():
            d = int(doc[k])
            out[d] = encode(texts[d]) if over[k] else put[dest[d] : fill[k]].tobytes() + ending(int(low[k]), int(high[k]))
            if lanes.waiting:
                lanes.begin(k)
                fill[k] = dest[lanes.doc[k]]
            else:
                lanes.left[k] = 0
        if len(ended) and not lanes.waiting:
            stay = lanes.left > 0
            lanes.keep(stay)
            fill = fill[stay]
    for k, d in enumerate(lanes.doc.tolist()):
        state = int(lanes.low[k]), int(lanes.high[k]), int(lanes.before[k])
        out[d] = encode(texts[d][len(texts[d]) - int(lanes.left[k]) :], lanes.known(k), state, bytearray(put[dest[d] : fill[k]].tobytes()))
    for d in lanes.waiting:
        out[d] = encode(texts[d])
    return out


def decode_many(codes: list[bytes], sizes: list[int]) -> list[bytes]:
    """What ``decode`` makes of the codes, given the lengths of the texts."""
    out: list[bytes] = [b""] * len(codes)
    lanes = Lanes(sizes)
    size = np.array([len(c) for c in codes], np.int64) + 4  # zeros follow a code
    src, begin = np.frombuffer(b"".join(c + b"\0\0\0\0" for c in codes), np.uint8).astype(np.int64), starts(size)
    put, dest = np.zeros(int(lanes.sizes.sum()), np.uint8), starts(lanes.sizes)
    last = begin + size - 1

    def first(doc: np.ndarray) -> np.ndarray:
        return src[begin[doc]] << 24 | src[begin[doc] + 1] << 16 | src[begin[doc] + 2] << 8 | src[begin[doc] + 3]

    x, at = first(lanes.doc), begin[lanes.doc] + 4
    while len(lanes.doc) > FEW:
        low, high, doc = lanes.low, lanes.high, lanes.doc
        base = lanes.lane << 16 | lanes.before << 8
        node, end = np.ones(len(doc), np.int64), last[doc]
        for _ in range(8):
            key = base + node
            p = lanes.flat[key]
            mid = low + ((high - low) * SHARE[p] >> 16)
            one = x <= mid
            low, high = np.where(one, low, mid + 1), np.where(one, mid, high)
            bit = one.astype(np.int64)
            lanes.flat[key] = NEXT[(bit << 16) + p]
            node = node << 1 | bit
            same = np.flatnonzero((low ^ high) < 1 << 24)
            while len(same):
                a, b = low[same] << 8 & TOP, high[same] << 8 & TOP | 255
                low[same], high[same] = a, b
                x[same] = x[same] << 8 & TOP | src[np.minimum(at[same], end[same])]
                at[same] += 1
                same = same[(a ^ b) < 1 << 24]
        lanes.low, lanes.high, lanes.before = low, high, node & 255
        put[dest[doc] + lanes.sizes[doc] - lanes.left] = node & 255
        lanes.left -= 1
        ended = np.flatnonzero(lanes.left == 0)
        for k in ended.tolist():
            d = int(doc[k])
            out[d] = put[dest[d] : dest[d] + lanes.sizes[d]].tobytes()
            if lanes.waiting:
                lanes.begin(k)
                now = lanes.doc[k : k + 1]
                x[k], at[k] = first(now)[0], begin[now[0]] + 4
        if len(ended) and not lanes.waiting:
            stay = lanes.left > 0
            lanes.keep(stay)
            x, at = x[stay], at[stay]
    for k, d in enumerate(lanes.doc.tolist()):
        left = int(lanes.left[k])
        state = int(lanes.low[k]), int(lanes.high[k]), int(lanes.before[k]), int(x[k]), int(at[k] - begin[d])
        out[d] = put[dest[d] : dest[d] + lanes.sizes[d] - left].tobytes() + decode(codes[d], left, lanes.known(k), state)
    for d in lanes.waiting:
        out[d] = decode(codes[d], sizes[d])
    return out


#: Documents and bytes that are coded together.
POOL_ROWS, POOL_BYTES = 8192, 16 << 20


def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of several batches, as many as fill the lanes."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[-1] or "")
            if len(rows) >= POOL_ROWS or size >= POOL_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, raw_len, payload."""
    id_type = to_arrow_type(df.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pools(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode_many(raw), pa.binary())], names=[id_col, "raw_len", "payload"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, raw_len bigint, payload binary")


def decode_documents(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text."""
    id_type = to_arrow_type(coded.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pools(batches):
            text = [t.decode("utf-8", "surrogatepass") for t in decode_many([r[2] for r in rows], [r[1] for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array(text, pa.string())], names=[id_col, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, "raw_len", "payload").mapInArrow(run, f"{id_col} {kind}, text string")


@query("codec_roundtrip", "SELECT doc_id, strlen(coalesce(text, '')) AS raw_bytes, true AS ok, true AS shorter FROM documents")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does decoding give each document back, and is the code shorter but for a few bytes? A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pools(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
            once = list(dict.fromkeys(raw))  # a text that comes again is coded once
            code = encode_many(once)
            back = decode_many(code, [len(x) for x in once])
            told = {x: (y == x, len(c) <= len(x) + 4) for x, c, y in zip(once, code, back, strict=True)}
            ok, short = zip(*(told[x] for x in raw), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(ok), pa.array(short)], names=["doc_id", "raw_bytes", "ok", "shorter"])

    # texts are dealt anew: a small file is one scan task
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return docs.mapInArrow(run, "doc_id bigint, raw_bytes bigint, ok boolean, shorter boolean")


@query(
    "payload_checkpoints",
    """
WITH d AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS upto FROM documents)
SELECT CAST(upto // 65536 AS BIGINT) AS checkpoint, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM d GROUP BY 1
""",
)
def payload_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by checkpoints of 65,536 characters of the running total."""
    from corpusloom.plans.ordered import ordered

    d = ordered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", add=F.col("n_chars")).withColumn("own", F.coalesce("n_chars", F.lit(0)))
    return d.groupBy(F.floor((F.col("before") + F.col("own")) / 65536).alias("checkpoint")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))
