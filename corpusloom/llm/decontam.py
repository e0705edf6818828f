"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised bytewise: A-Z become a-z, every other ASCII byte that is no
digit or letter becomes a blank, and words are joined by single blanks. A window
is ``width`` consecutive words of an item (the whole item if it is shorter). All
windows go into one automaton with a blank on either side, so each text is scanned
once and a match always covers whole words. Word numbers lead back to offsets in
the original text (``spans=True``).

The windows of the benchmark are a table of distinct rows. If they take at most
``shard_bytes`` (counted first), one automaton over all of them scans every text in one
pass. A larger benchmark never comes to the driver: its windows are dealt to shards by
their hash, and a filter of FILTER_BITS bits over these hashes is all that is broadcast.
One pass over the texts finds the shards in whose windows a text may have a part; only
such texts go on, to the automata of those shards, which the windows of a shard meet as
rows of a sorted partition. A shard's texts are dealt to several tasks by their row.

Defined results: a null text has no words; an item without words has no window; a
null item_id counts as the empty id; repeated item_ids count once; repeated windows are
one; texts are scanned whole, however long; repeated rows get a row and the same result
each; with an empty benchmark nothing is hit; an empty table gives an empty result; a
carried column that has the name of a result is renamed (see ``carried``), other extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import WORD_TABLE, SpanHash, carried, row_and_text, slices, splitmix, text_sizes, texts_of
from corpusloom.session import materialize, release

WIDTH = 10
#: Bytes of windows of one automaton.
SHARD_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows: g (the words between blanks), n (words), h (hash), items (sorted ids that have it)."""
    src = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(WINDOW_SEED)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(t)
                spans = [w[k : k + width] for k in range(max(1, len(w) - width + 1) if w else 0)]
                raw = [b" " + b" ".join(x) + b" " for x in spans]
                for lo in range(0, len(raw), 4096):
                    part = raw[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([len(x) for x in spans[lo : lo + 4096]], pa.int32()), pa.array(span_hashes(part, hasher)), pa.array([i] * len(part))], names=["g", "n", "h", "i"])

    got = src.mapInArrow(run, "g binary, n int, h bigint, i string")
    return got.groupBy("g", "n", "h").agg(F.array_sort(F.collect_set("i")).alias("items"))


def span_hashes(raw: list[bytes], hasher: SpanHash) -> np.ndarray:
    """64-bit hashes of strings."""
    ends = np.cumsum([0, *map(len, raw)])
    return splitmix(hasher.spans(hasher.sums(np.frombuffer(b"".join(raw), np.uint8)), ends[:-1], ends[1:])).view(np.int64)


def automaton(rows: list[tuple[bytes, int, list[str]]]) -> ahocorasick.Automaton | None:
    """Maps a window to (its words, the items that have it)."""
    auto = ahocorasick.Automaton()
    for g, n, items in rows:
        auto.add_word(bytes(g).decode("latin-1"), (n, tuple(items)))
    if not rows:
        return None
    auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, hit word ranges (merged, end exclusive) and the items found."""
    words = words_of(text)
    if not words:
        return 0, [], set()
    flat = b" " + b" ".join(words) + b" "
    found = list(auto.iter(flat.decode("latin-1")))
    if not found:
        return len(words), [], set()
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    who: set[str] = set()
    runs = []
    for end, (n, items) in found:
        last = int(np.searchsorted(blanks, end))
        runs.append((last - n, last))
        who.update(items)
    return len(words), merge(runs), who


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets of word ranges in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(point[starts[a]] - 1), int(point[ends[b - 1] - 1])) for a, b in runs]


HITS = "array<struct<a:bigint,b:bigint>>"


def finder(auto: Callable[[], ahocorasick.Automaton | None], texts_at: Callable[[pa.RecordBatch], pa.Array], spans: bool) -> Callable:
    """A mapInArrow function: the first column, the words of the text, hit ranges, items, and hit ranges in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = auto()
        for batch in batches:
            for i, j in slices(text_sizes(texts_at(batch)), 4 << 20):
                part = batch.slice(i, j - i)
                yield found_in(part.column(0), texts_at(part).to_pylist(), machine, spans)

    return run


def found_in(row: pa.Array, texts: list[str | None], machine: ahocorasick.Automaton | None, spans: bool) -> pa.RecordBatch:
    count, runs, items, chars = [], [], [], []
    for t in texts:
        n, hit, who = scan(machine, t) if machine is not None else (len(words_of(t)), [], set())
        count.append(n)
        runs.append([{"a": x, "b": y} for x, y in hit])
        items.append(sorted(who))
        chars.append([{"a": x, "b": y} for x, y in char_spans(t, hit)] if spans and hit else [])
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.RecordBatch.from_arrays([row, pa.array(count, pa.int64()), pa.array(runs, pair), pa.array(items, pa.list_(pa.string())), pa.array(chars, pair)], names=["row", "n", "runs", "items", "chars"])


#: Bits of the filter over window hashes; the leading bits of the hash are the slot, the following ones tell the shard.
FILTER_BITS = 27
WINDOW_SEED = 23


def window_filter(table: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, however many windows there are."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = table.select(slot.alias("s")).selectExpr("s div 64 AS w", "shiftleft(1L, cast(s % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.b
    return out


def shards_of(text: str | None, sizes: list[int], known: np.ndarray, n_shards: int, hasher: SpanHash) -> list[int]:
    """The shards that a window of the text may be in."""
    words = words_of(text)
    if not words:
        return []
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sums = hasher.sums(flat)
    blanks = np.flatnonzero(flat == 32)
    out: set[int] = set()
    for n in sizes:
        if len(words) >= n:
            h = splitmix(hasher.spans(sums, blanks[:-n], blanks[n:] + 1))
            slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            h = h[(known[slot >> 6] >> (slot & 63)) & 1 == 1]
            out.update(((h << np.uint64(FILTER_BITS) >> np.uint64(34)) % np.uint64(n_shards)).astype(np.int64).tolist())
    return sorted(out)


def find_in_shards(cur: DataFrame, table: DataFrame, n_shards: int, sizes: list[int], deals: int) -> DataFrame:
    """For rows (key, t): key, hit ranges and items, from the shards that the filter lets a text through to."""
    spark = cur.sparkSession
    known = spark.sparkContext.broadcast(window_filter(table))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(WINDOW_SEED)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shards_of(t, sizes, known.value, n_shards, hasher)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([k % deals] * len(own), pa.int64()), pa.array([1] * len(own), pa.int32()), pa.array([k] * len(own), pa.int64()), pa.array([t] * len(own), pa.string())], names=["shard", "deal", "kind", "key", "t"])

    rows = "shard bigint, deal bigint, kind int, key bigint, t string"
    none = F.lit(None)
    texts = cur.select("key", "t").mapInArrow(deal, rows).select("shard", "deal", "kind", "key", "t", none.cast("binary").alias("g"), none.cast("int").alias("n"), none.cast("array<string>").alias("items"))
    shard = F.shiftrightunsigned(F.shiftleft("h", FILTER_BITS), 34) % n_shards
    # a shard's windows go to each of its tasks
    own = table.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))).alias("deal"), F.lit(0).alias("kind"), none.cast("bigint").alias("key"), none.cast("string").alias("t"), "g", "n", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, machine = None, [], None
        for batch in batches:
            key, runs, items = [], [], []
            for s, d, kind, k, t, g, n, who in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, d) != now:
                    now, held, machine = (s, d), [], None
                if kind == 0:
                    held.append((g, n, who))
                    continue
                if machine is None:
                    if not held:
                        continue  # the filter was wrong
                    machine, held = automaton(held), held[:1]
                _, hit, names = scan(machine, t)
                if hit:
                    key.append(k)
                    runs.append([{"a": x, "b": y} for x, y in hit])
                    items.append(sorted(names))
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(runs, pair), pa.array(items, pa.list_(pa.string()))], names=["key", "runs", "items"])

    both = texts.unionByName(own).repartition(parts, "shard", "deal").sortWithinPartitions("shard", "deal", "kind")
    got = both.mapInArrow(run, f"key bigint, runs {HITS}, items array<string>")
    return got.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, carry: list[str] | None = None, shard_bytes: int = SHARD_BYTES, spans: bool = False) -> DataFrame:
    """``carry`` (default: doc_id) with n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, the hit spans in code points."""
    carry = ["doc_id"] if carry is None else carry
    spark = df.sparkSession
    table = materialize(windows(benchmark, item_col, item_text, width), "windows")
    total, sizes = table.agg(F.sum(F.octet_length("g") + 8 + F.size("items") * 8), F.collect_set("n")).first()
    cur = row_and_text(df, carry, text_col)
    kind = cur.schema["__row"].dataType.simpleString()
    if (total or 0) <= shard_bytes:
        rows = [(bytes(r.g), r.n, list(r.items)) for r in table.collect()]
        release(table)
        known = spark.sparkContext.broadcast(rows)  # at most shard_bytes
        schema = T.StructType([T.StructField("row", cur.schema["__row"].dataType), *T.StructType.fromDDL(f"n bigint, runs {HITS}, items array<string>, chars {HITS}").fields])
        got = cur.mapInArrow(finder(lambda: automaton(known.value), lambda batch: texts_of(batch, carry, text_col), spans), schema)
    else:
        n_shards = -(-total // shard_bytes)
        deals = max(1, min(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
        text = F.col("__row").getField(text_col) if text_col in carry else F.col("__text")
        cur = materialize(cur.select(F.col("__row").alias("row"), text.alias("t")).withColumn("key", F.monotonically_increasing_id()), "texts")
        hits = materialize(find_in_shards(cur, table, n_shards, sorted(sizes), deals), "hits").withColumnRenamed("key", "k")
        got = cur.join(hits, F.col("key") == F.col("k"), "left").mapInArrow(finish(spans, cur.schema.fieldNames().index("t")), T.StructType([cur.schema["row"], *T.StructType.fromDDL(f"n bigint, runs {HITS}, items array<string>, chars {HITS}").fields]))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, x: acc + x.b - x.a)
    got = got.withColumn("items", F.array_sort("items"))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    return got.select(
        *carried("row", carry, names if spans else names[:-1]),
        F.col("n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *([F.col("chars").alias("spans")] if spans else []),
    )


def finish(spans: bool, text_at: int) -> Callable:
    """Joins a text with the hits that its shards found: (row, t, key, k, runs, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            runs = [merge([(x["a"], x["b"]) for x in r or ()]) for r in batch.column(batch.num_columns - 2).to_pylist()]
            chars = [[{"a": x, "b": y} for x, y in char_spans(t, r)] if spans and r else [] for t, r in zip(texts, runs, strict=True)]
            items = [x or [] for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([[{"a": x, "b": y} for x, y in r] for r in runs], pair), pa.array(items, pa.list_(pa.string())), pa.array(chars, pair)], names=["row", "n", "runs", "items", "chars"])

    return run
