"""Matches of the past: lag matches, donors, frequent patterns, echoes, morphology, containment."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.known import Known
from corpusloom.operators.symbols import code_points
from corpusloom.plans.registry import query
from corpusloom.session import materialize
from corpusloom.sources.tables import dealt, table

GRAM = 8


def gram_ids(cp: np.ndarray, k: int) -> np.ndarray:
    """Equal numbers for equal k-grams, exactly: names of pairs are doubled until they cover k symbols."""
    ids = np.unique(cp, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < k:
        step = min(have, k - have)
        left, right = ids[: len(ids) - step], ids[step:]
        if not len(left):
            return np.zeros(0, np.int64)
        ids = np.unique(left * (int(ids.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    return ids


def previous(ids: np.ndarray, back: int = 1) -> np.ndarray:
    """The place of the back-th earlier equal value, or -1."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1, np.int64)
    a, b = order[:-back] if back else order, order[back:]
    same = ids[a] == ids[b]
    out[b[same]] = a[same]
    return out


def islands(cp: np.ndarray, k: int = GRAM) -> tuple[int, int]:
    """Places whose k-gram occurred before, and the longest run of them at one distance."""
    prev = previous(gram_ids(cp, k)) if len(cp) >= k else np.zeros(0, np.int64)
    at = np.flatnonzero(prev >= 0)
    if not len(at):
        return 0, 0
    offset = at - prev[at]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (offset[1:] != offset[:-1])]))
    return len(at), int(np.diff(np.append(new, len(at))).max())


def donor_hits(cp: np.ndarray, k: int = GRAM) -> tuple[int, int]:
    """Predictions of the next symbol by the last donor, and those that come true."""
    if len(cp) <= k:
        return 0, 0
    ids = gram_ids(cp, k)[:-1]  # contexts that have a next symbol
    prev = previous(ids)
    at = np.flatnonzero(prev >= 0)
    return len(at), int((cp[at + k] == cp[prev[at] + k]).sum())


def donor_votes(cp: np.ndarray, k: int = GRAM, donors: int = 4) -> tuple[int, int]:
    """Places where the votes of the four latest donors have one winner, and those where it is right."""
    if len(cp) <= k:
        return 0, 0
    ids = gram_ids(cp, k)[:-1]
    nxt = cp[k:].astype(np.int64)
    votes = np.stack([np.where(p >= 0, nxt[np.maximum(p, 0)], -1 - d) for d in range(donors) for p in [previous(ids, d + 1)]])
    count = np.where(votes >= 0, (votes[:, None, :] == votes[None, :, :]).sum(1), 0)
    best = count.max(0)
    winner = np.where(count == best, votes, -1)
    top = winner.max(0)
    alone = (best > 0) & ((winner == top) | (winner == -1)).all(0)
    return int(alone.sum()), int((alone & (top == nxt)).sum())


def per_document(spark: SparkSession, sf_dir: str, fn, names: tuple[str, str]) -> DataFrame:  # noqa: ANN001
    """Two counts for each document, found where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fn(code_points(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([int(g[k]) for g in got], pa.int64()) for k in (0, 1))], names=["doc_id", *names])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {names[0]} bigint, {names[1]} bigint")


GRAM_SQL = """
WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents WHERE text <> ''),
k AS (SELECT doc_id, p, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w || lead(c, 4) OVER w || lead(c, 5) OVER w || lead(c, 6) OVER w || lead(c, 7) OVER w AS g, lead(c, 8) OVER w AS nxt
      FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT * FROM k WHERE g IS NOT NULL)
"""


@query(
    "ngram_match_islands",
    GRAM_SQL
    + """, m AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id, g ORDER BY p) AS o FROM g),
r AS (SELECT doc_id, o, p - row_number() OVER (PARTITION BY doc_id, o ORDER BY p) AS k FROM m WHERE o IS NOT NULL),
l AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, o, k),
t AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_matched, max(n) AS longest FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matched, 0) AS n_matched, coalesce(longest, 0) AS longest FROM documents d LEFT JOIN t USING (doc_id)
""",
)
def ngram_match_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(spark, sf_dir, islands, ("n_matched", "longest"))


@query(
    "donor_next_symbol_hits",
    GRAM_SQL
    + """, m AS (SELECT doc_id, nxt, lag(nxt) OVER (PARTITION BY doc_id, g ORDER BY p) AS guess FROM g WHERE nxt <> ''),
t AS (SELECT doc_id, count(guess) AS n_predicted, count(*) FILTER (WHERE guess = nxt) AS n_hit FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_hit, 0) AS n_hit FROM documents d LEFT JOIN t USING (doc_id)
""",
)
def donor_next_symbol_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(spark, sf_dir, donor_hits, ("n_predicted", "n_hit"))


@query(
    "donor_votes_top4",
    GRAM_SQL
    + """, m AS (SELECT doc_id, p, nxt, lag(nxt, 1) OVER w AS a1, lag(nxt, 2) OVER w AS a2, lag(nxt, 3) OVER w AS a3, lag(nxt, 4) OVER w AS a4
      FROM g WHERE nxt <> '' WINDOW w AS (PARTITION BY doc_id, g ORDER BY p)),
v AS (SELECT doc_id, p, nxt, unnest([a1, a2, a3, a4]) AS a FROM m WHERE a1 IS NOT NULL),
c AS (SELECT doc_id, p, nxt, a, count(*) AS n FROM v WHERE a IS NOT NULL GROUP BY ALL),
b AS (SELECT *, rank() OVER (PARTITION BY doc_id, p ORDER BY n DESC) AS r FROM c),
w AS (SELECT doc_id, p, nxt, min(a) AS a, count(*) AS k FROM b WHERE r = 1 GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_spoken, count(*) FILTER (WHERE a = nxt) AS n_hit FROM w WHERE k = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_spoken, 0) AS n_spoken, coalesce(n_hit, 0) AS n_hit FROM documents d LEFT JOIN t USING (doc_id)
""",
)
def donor_votes_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(spark, sf_dir, donor_votes, ("n_spoken", "n_hit"))


WORD_GRAM_SQL = "SELECT {id}, array_to_string(w[i : i + {k} - 1], ' ') AS g FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {t}) x, unnest(range(1, len(w) - {k} + 2)) t(i)"


@query(
    "benchmark_containment",
    f"""
WITH d AS ({WORD_GRAM_SQL.format(id="doc_id", k=8, t="documents")}), b AS (SELECT DISTINCT g FROM ({WORD_GRAM_SQL.format(id="item_id", k=8, t="benchmark")}))
SELECT doc_id, count(*) AS n_grams, count(*) FILTER (WHERE g IN (SELECT g FROM b)) AS n_contained FROM d GROUP BY doc_id
""",
)
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a document's 8-word grams some benchmark item donates.

    A filter of CONTAINED_BITS bits over the hashes of the benchmark's grams is
    broadcast; documents stay where they are, and only grams that it lets through are
    joined, compared in full. Repeated document ids are counted together.
    """
    words = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("k"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("w")).filter(F.size("w") >= GRAM)
    grams = words("benchmark", "item_id").mapInArrow(hashed_grams, "k bigint, n bigint, g array<string>, h array<bigint>")
    grams = grams.select(F.explode(F.arrays_zip("g", "h")).alias("x")).select("x.g", "x.h").distinct()
    words_of_filter = grams.selectExpr(f"pmod(h, {CONTAINED_BITS}) AS s").groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("b"))
    bits = np.zeros(CONTAINED_BITS // 64, np.int64)  # however large the benchmark
    for r in words_of_filter.toLocalIterator():
        bits[r.w] = r.b
    # documents are read once: a row for each tells its number of grams, further rows the grams to compare
    low = dealt(table(spark, sf_dir, "documents").select("doc_id", F.encode(F.lower("text"), "utf-8").alias("t")))
    d = low.mapInArrow(possible_grams(spark.sparkContext.broadcast(bits)), "doc_id bigint, n bigint, g string")
    # a row without a gram gets a key of its own that no gram has, so that such rows don't meet in one task
    d = d.withColumn("g", F.coalesce("g", F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    both = d.join(grams.select("g", F.lit(1).alias("k")).distinct(), "g", "left")
    return both.groupBy("doc_id").agg(F.sum("n").alias("n_grams"), F.count("k").alias("n_contained"))


POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM)], np.uint64)


def gram_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the grams of words of these hashes."""
    n = len(h) - GRAM + 1
    g = sum(h[k : k + n] * POWERS[k] for k in range(GRAM))
    return (g ^ (g >> np.uint64(29))).view(np.int64)


WORD_BYTES = re.compile(rb"[a-z0-9]+")


def possible_grams(known):  # noqa: ANN001, ANN201
    """A mapInArrow function over (id, lower-cased bytes): a row (id, number of grams, null), and (id, 0, gram) for each that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Known(zlib.crc32)
        for batch in batches:
            ids, counts, texts = [], [], []
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = WORD_BYTES.findall(t or b"")
                n = len(w) - GRAM + 1
                if n < 1:
                    continue
                ids.append(i)
                counts.append(n)
                texts.append(None)
                g = gram_hashes(np.fromiter(map(crc.__getitem__, w), np.uint64, len(w)))
                s = np.mod(g, CONTAINED_BITS)
                at = np.flatnonzero((known.value[s >> 6] >> (s & 63)) & 1).tolist()
                ids += [i] * len(at)
                counts += [0] * len(at)
                texts += [b" ".join(w[k : k + GRAM]).decode() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n", "g"])

    return run


def hashed_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) to (k, n, g, h): id, the number of grams, all of them and their hashes."""
    for batch in batches:
        count, texts, hashes = [], [], []
        for w in batch.column(1).to_pylist():
            g = gram_hashes(np.array([zlib.crc32(x.encode()) for x in w], np.uint64))
            count.append(len(g))
            texts.append([" ".join(w[i : i + GRAM]) for i in range(len(g))])
            hashes.append(g)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names=["k", "n", "g", "h"])


#: Bits of the filter over the benchmark's grams.
CONTAINED_BITS = 1 << 22


#: Words of a pattern, and how many patterns are told.
PATTERN, PATTERNS = 3, 128
#: Buckets in which patterns are counted by hash; the fullest are counted by text before the others are judged.
BUCKETS, FULLEST, BLOCK = 1 << 20, 1 << 12, 1 << 12
#: Bytes of text that are split into words at a time, and patterns that a task counts before it hands them on.
PIECE, COUNTED = 1 << 18, 1 << 17

NO_WORD_BYTE = re.compile(rb"[^a-z0-9]")
IS_WORD_BYTE = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2 ** 64, and of its inverse."""
    odd = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.array([1] + [r] * (n - 1), np.uint64)) for r in (odd, pow(odd, -1, 1 << 64)))


def patterns_of(texts: list[bytes | None], size: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The patterns of lower-cased texts, a piece after the other: words with a space between, where in them a pattern begins and ends, its bucket.

    A piece ends at a byte outside words, and the next begins with its last words, of
    which no pattern has been told. A pattern's hash is a difference of running sums.
    """
    data = b"\n".join(t or b"" for t in texts)
    whole = np.frombuffer(data, np.uint8)
    stops = np.cumsum([len(t or b"") + 1 for t in texts]) - 1
    start = end = 0
    while end < len(data):
        cut = NO_WORD_BYTE.search(data, end + size)
        end = cut.start() if cut else len(data)
        piece = whole[start:end]
        word = IS_WORD_BYTE[piece]
        before = np.concatenate([[False], word[:-1]])
        begins = np.flatnonzero(word & ~before)
        kept = np.flatnonzero(word | before)  # each word and the byte after it
        text = np.where(word, piece, 32)[kept]
        to = np.flatnonzero(text == 32)
        if len(to) < len(begins):
            to = np.append(to, len(text))
        n = len(begins) - PATTERN + 1
        if n > 0:
            inside = np.ones(n, bool)
            told = np.searchsorted(begins, stops[np.searchsorted(stops, start, "right") : np.searchsorted(stops, end, "right")] - start)
            for k in range(1, PATTERN):  # no pattern begins with the last words of a text
                last = told - k
                inside[last[(last >= 0) & (last < n)]] = False
            at, to = np.concatenate([[0], to[:-1] + 1])[:n][inside], to[PATTERN - 1 :][inside]
            up, down = powers(max(2 * PIECE, 1 << len(text).bit_length()))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * up[: len(text)])])
            h = (sums[to] - sums[at]) * down[at]
            h = (h ^ h >> np.uint64(32)) * up[1]
            yield text.tobytes(), at, to, (h >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)
        start = start + int(begins[max(0, n)]) if len(begins) else end


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (block, counts): how many patterns a task has in each bucket, a row for a block of them."""
    counts = np.zeros(BUCKETS, np.int64)
    some, n = [], 0
    for batch in batches:
        for *_, b in patterns_of(batch.column(0).to_pylist()):
            some.append(b)
            n += len(b)
            if n >= BUCKETS:
                counts += np.bincount(np.concatenate(some), minlength=BUCKETS)
                some, n = [], 0
    if n:
        counts += np.bincount(np.concatenate(some), minlength=BUCKETS)
    blocks = counts.reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([blocks[k].tobytes() for k in at], pa.binary())], names=["block", "counts"])


def summed(rows: pa.Table) -> pa.Table:
    """The rows of one block as one row."""
    total = np.zeros(BLOCK, np.int64)
    for c in rows.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"block": rows.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def patterns_in(chosen):  # noqa: ANN001, ANN201
    """A mapInArrow function over (text): (pattern, n) for those in the chosen buckets, some counted more than once in parts."""

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g.decode() for g in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, at, to, b in patterns_of(batch.column(0).to_pylist()):
                mine = chosen.value[b]
                found.update([text[i:j] for i, j in zip(at[mine].tolist(), to[mine].tolist(), strict=True)])
                if len(found) >= COUNTED:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    return run


@query(
    "frequent_patterns",
    f"WITH d AS ({WORD_GRAM_SQL.format(id='doc_id', k=3, t='documents')}) SELECT g AS pattern, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, pattern LIMIT 128",
)
def frequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 128 most frequent word trigrams, ties by text.

    Trigrams are counted in BUCKETS buckets of their hashes first. Those of the fullest
    buckets are then counted by text; another bucket can hold one of the 128 only if it
    has no fewer than the last of them, and such buckets are counted by text too. So
    rare trigrams, which are most, never leave their task.
    """
    texts = dealt(table(spark, sf_dir, "documents").select("text")).select(F.lower("text").cast("binary").alias("t"))
    counts = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)  # however many the documents
    for r in texts.mapInArrow(bucket_counts, "block int, counts binary").groupBy("block").applyInArrow(summed, "block int, counts binary").toLocalIterator():
        counts[r.block] = np.frombuffer(r.counts, np.int64)
    counts = counts.reshape(-1)

    def most_frequent(df: DataFrame) -> DataFrame:
        return df.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pattern").limit(PATTERNS)

    def within(chosen: np.ndarray) -> DataFrame:
        return most_frequent(texts.mapInArrow(patterns_in(spark.sparkContext.broadcast(chosen)), "pattern string, n bigint"))

    first = np.zeros(BUCKETS, bool)
    first[np.argpartition(counts, -FULLEST)[-FULLEST:]] = True
    best = materialize(within(first & (counts > 0)), "patterns")
    found = best.agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    last = found.least if found.rows == PATTERNS else 1
    others = ~first & (counts >= last)
    return most_frequent(best.unionByName(within(others)) if others.any() else best)


@query(
    "suffix_next_letter",
    """
WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w),
s AS (SELECT substr(w, e - k + 1, k) AS suffix, least(7, e) AS len_class, substr(w, e + 1, 1) AS nxt, n FROM w, unnest(range(2, length(w))) a(e), range(2, 6) b(k) WHERE k <= e),
c AS (SELECT suffix, len_class, nxt, sum(n) AS n FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY suffix, len_class ORDER BY n DESC, nxt) AS r, sum(n) OVER (PARTITION BY suffix, len_class) AS total FROM c)
SELECT suffix, CAST(len_class AS INT) AS len_class, nxt, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM r WHERE r = 1
""",
)
def suffix_next_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the last 2 to 5 letters of what has been read of a word, and how long that is (7 at most): the most frequent next letter."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    w = w.filter(F.length("w") > 2).select("w", "n", F.explode(F.sequence(F.lit(2), F.length("w") - 1)).alias("e"))
    s = w.select("w", "n", "e", F.explode(F.sequence(F.lit(2), F.least(F.lit(5), "e"))).alias("k"))
    s = s.select(F.expr("substr(w, e - k + 1, k)").alias("suffix"), F.least(F.lit(7), "e").alias("len_class"), F.expr("substr(w, e + 1, 1)").alias("nxt"), "n")
    c = s.groupBy("suffix", "len_class", "nxt").agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("nxt"))).alias("b")
    return c.groupBy("suffix", "len_class").agg(best, F.sum("n").alias("total")).select("suffix", "len_class", F.col("b.nxt").alias("nxt"), (-F.col("b.m")).alias("n"), "total")


@query(
    "title_echo",
    """
WITH t AS (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, title, CAST(CASE WHEN title = '' THEN 0 ELSE (length(html) - length(replace(html, title, ''))) / length(title) - 1 END AS BIGINT) AS n_echo FROM t
""",
)
def title_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a page's title occurs again in the page."""
    t = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    n = ((F.length("html") - F.length(F.replace(F.col("html"), F.col("title"), F.lit("")))) / F.length("title") - 1).cast("bigint")
    return t.select("page_id", "title", F.when(F.col("title") == "", F.lit(0).cast("bigint")).otherwise(n).alias("n_echo"))


@query(
    "piped_links",
    r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)
SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE label <> '' AND contains(lower(target), lower(label))) AS n_copied FROM l GROUP BY page_id
""",
)
def piped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page, and those whose label can be read off the target."""
    rx = F.lit('<a href="([^"]*)">([^<]*)</a>')
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.arrays_zip(F.regexp_extract_all("html", rx, 1).alias("target"), F.regexp_extract_all("html", rx, 2).alias("label"))).alias("l"))
    copied = (F.col("l.label") != "") & F.contains(F.lower("l.target"), F.lower("l.label"))
    return p.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(copied).alias("n_copied"))
