"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Tokens. Documents become ids of the given tokenizer and an end id; those longer
than a sequence are cut into pieces of its size. The ids of a text are those of the
words that the tokenizer splits it into, which are kept in a bounded cache.

Packing. Pieces that fill a sequence stand alone. The others are dealt by a hash
into blocks of about ``block`` pieces. Each block evolves on ``islands`` islands
(separate tasks): a chromosome is a set of bins, crossover injects the best filled
bins of one parent whole into the other, drops the bins that now hold duplicates
and best-fits the displaced pieces. Between the epochs each island's elite migrates
to the next island through a shuffle. After a round, bins with little slack are
final; the pieces of the others are dealt into fewer blocks and evolve again, until
one block is left or ``rounds`` are over. No task sees more than a block.

Defined results: a null text counts as empty (the end id alone); repeated rows are
packed as often as they occur; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import random
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SpanHash, batch_sizes, slices
from corpusloom.session import materialize

SEQUENCE = 4096
END_ID = 1
#: Words whose ids a worker keeps, about 100 MB; then it starts anew.
CACHE_WORDS = 400_000
#: Most tasks of one epoch.
MAX_TASKS = 4096


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class WordCoder:
    """Ids of texts as unsigned 32-bit numbers.

    For texts of plain Latin-1 characters the tokenizer's own splitting rule is
    applied here, with numpy, to the lower-cased bytes of many texts at once. Words
    are told apart by 64-bit hashes, and the ids of each word are kept in a bounded
    cache. All other texts go through the tokenizer whole.
    """

    plain = bytes([9, 10, 13, *range(32, 127), *range(0xA1, 0x100)])
    blank, letter, digit, other = range(4)

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.letters = byte_letters()
        self.hash = SpanHash()
        self.splits_here = self._known_rule()
        kinds = [self.other] * 256
        for b in range(256):
            c = chr(b)
            kinds[b] = self.blank if c in " \t\n\r" else self.letter if c.isalpha() else self.digit if unicodedata.category(c)[0] == "N" else self.other
        self.kinds = np.array(kinds, np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(CACHE_WORDS * 2, np.int64)  # where the ids of a slot begin; those of slot k end where k + 1 begins

    def _known_rule(self) -> bool:
        """Is this the tokenizer whose splitting rule is written here?"""
        kind = json.loads(self.tok.to_str())
        pre = json.dumps(kind["pre_tokenizer"])
        return [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        easy, rows = [], []
        for k, t in enumerate(texts):
            try:
                raw = t.lower().encode("latin-1")
                odd = t.encode("latin-1").translate(None, self.plain)
            except UnicodeEncodeError:
                odd = b"?"
            if odd or not self.splits_here or "<|" in t:
                out[k] = self.whole(t)
            else:
                easy.append(raw)
                rows.append(k)
        for i, j in slices(np.array([len(x) + 1 for x in easy], np.int64), 2 << 20):
            for k, ids in zip(rows[i:j], self._encode(easy[i:j]), strict=True):
                out[k] = ids
        return out

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words; each text ends with a line feed."""
        kind = self.kinds[data]
        edge = np.empty(len(data), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == self.digit
        # an apostrophe alone between a word and one of s t m d re ve ll takes these letters along
        tick = np.flatnonzero((data == 39) & edge)
        tick = tick[tick + 1 < len(data)]
        if len(tick):
            a, b = data[tick + 1], data[np.minimum(tick + 2, len(data) - 1)]
            two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            three = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
            edge[tick[two | three] + 1] = False
            edge[tick[two] + 2] = True
            edge[tick[three] + 3] = True
        cut = np.flatnonzero(edge)
        ends = np.append(cut[1:], len(data))
        word = kind[cut] != self.blank
        return cut[word], ends[word]

    def _encode(self, raw: list[bytes]) -> list[np.ndarray]:
        buf = b"\n".join(raw) + b"\n"
        data = np.frombuffer(buf, np.uint8)
        starts, ends = self._words(data)
        back, keys = pd.factorize(self.hash.spans(self.hash.sums(data), starts, ends))
        first = np.empty(len(keys), np.int64)
        first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        slot = self._slots(buf, keys.tolist(), starts[first].tolist(), ends[first].tolist())
        begin, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        size = size[back]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin[back] - upto[:-1], size) + np.arange(upto[-1])]
        text_ends = np.cumsum([len(x) + 1 for x in raw])
        cut = upto[np.searchsorted(starts, text_ends)]
        return np.split(ids, cut[:-1])

    def _slots(self, buf: bytes, keys: list[int], starts: list[int], ends: list[int]) -> np.ndarray:
        if len(self.slots) > CACHE_WORDS:
            self._clear()
        if len(self.slots) + len(keys) + 2 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(keys) + 2, np.int64)])
        slot = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slot < 0)
        if len(new):
            n, merge, letters = len(self.slots), self.merge, self.letters
            ids: list[int] = []
            upto = []
            for k in new.tolist():
                raw = buf[starts[k] : ends[k]]
                word = raw.decode() if raw.isalpha() else raw.decode("latin-1").encode().decode("latin-1").translate(letters)
                ids += [t.id for t in merge(word)]
                upto.append(len(ids))
            slot[new] = np.arange(n, n + len(new))
            self.slots.update(zip(map(keys.__getitem__, new.tolist()), range(n, n + len(new)), strict=True))
            a = self.at[n]
            self.at[n + 1 : n + 1 + len(new)] = a + np.array(upto)
            while a + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[a : a + len(ids)] = ids
        return slot


_CODERS: dict[str, WordCoder] = {}


def coder_of(path: str) -> WordCoder:
    """One coder for each tokenizer and Python worker."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches:
            for i, j in slices(batch_sizes(batch), 8 << 20):
                yield one(coder, batch.slice(i, j - i))

    def one(coder: WordCoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        for k, got in enumerate(coder.encode_many([t or "" for t in batch.column(1).to_pylist()])):
            ids = got.astype("<u4").tobytes() + end
            for p, a in enumerate(range(0, len(ids), 4 * size)):
                part = ids[a : a + 4 * size]
                row.append(k)
                piece.append(p)
                start.append(a // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        ids = batch.column(0).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Bins over items of given sizes, with the open bins listed by slack."""

    def __init__(self, sizes: list[int], cap: int, bins: list[list[int]]) -> None:
        self.sizes, self.cap = sizes, cap
        self.bins = bins
        self.slack = [cap - sum(map(sizes.__getitem__, b)) for b in bins]

    def best_fit(self, items: list[int]) -> None:
        at: dict[int, list[int]] = {}
        mask = 0
        for b, s in enumerate(self.slack):
            at.setdefault(s, []).append(b)
            mask |= 1 << s
        for i in items:
            size = self.sizes[i]
            m = mask >> size
            if m:
                s = size + (m & -m).bit_length() - 1
                b = at[s].pop()
                if not at[s]:
                    mask ^= 1 << s
            else:
                s, b = self.cap, len(self.bins)
                self.bins.append([])
                self.slack.append(s)
            self.bins[b].append(i)
            s -= size
            self.slack[b] = s
            at.setdefault(s, []).append(b)
            mask |= 1 << s

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then full bins beside empty ones."""
        return len(self.bins), -float(np.square(self.cap - np.asarray(self.slack, float)).sum())


def cross(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Inject well-filled bins of b into a; best-fit what they displace."""
    order = sorted(range(len(b.bins)), key=lambda k: b.slack[k] + rng.random() * 0.05 * b.cap)
    take = [b.bins[k] for k in order[: max(1, int(len(order) * rng.uniform(0.2, 0.6)))]]
    inside = {i for x in take for i in x}
    kept, loose = [], []
    for x in a.bins:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in inside]
    child = Bins(a.sizes, a.cap, [list(x) for x in kept + take])
    child.best_fit(sorted(loose, key=a.sizes.__getitem__, reverse=True))
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Empty the worst filled bins and some others; best-fit their items."""
    order = sorted(range(len(a.bins)), key=lambda k: -a.slack[k] - rng.random() * 0.1 * a.cap)
    out = set(order[: max(2, len(order) // 12)])
    loose = [i for k in out for i in a.bins[k]]
    child = Bins(a.sizes, a.cap, [list(x) for k, x in enumerate(a.bins) if k not in out])
    rng.shuffle(loose)
    loose.sort(key=lambda i: -a.sizes[i] * rng.uniform(0.8, 1.0))
    child.best_fit(loose)
    return child


def evolve(sizes: list[int], cap: int, seeds: list[list[list[int]]], rng: random.Random, population: int, generations: int) -> Bins:
    least = -(-sum(sizes) // cap)
    pop = [Bins(sizes, cap, [list(b) for b in s]) for s in seeds]
    by_size = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    if not pop:
        first = Bins(sizes, cap, [])
        first.best_fit(by_size)
        pop.append(first)
    while len(pop) < population:
        some = Bins(sizes, cap, [])
        some.best_fit(sorted(by_size, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0)))
        pop.append(some)
    pop.sort(key=Bins.fitness)
    best_possible = (least, -((least - 1) * float(cap) ** 2 + float(sum(sizes) - (least - 1) * cap) ** 2))
    for _ in range(generations):
        if pop[0].fitness() <= best_possible:
            break
        x, y = sorted(rng.sample(range(len(pop)), 2)) if len(pop) > 1 else (0, 0)
        child = cross(pop[x], pop[y], rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        if child.fitness() < pop[-1].fitness():
            pop[-1] = child
            pop.sort(key=Bins.fitness)
    return pop[0]


def pack(parts: DataFrame, size: int = SEQUENCE, block: int = 4096, islands: int = 2, rounds: int = 4, population: int = 5, generations: int = 16, slack: int = 8) -> DataFrame:
    """Assign rows (pk, length) to sequences: pk, sequence_id, offset. ``pk`` must be unique."""
    todo = parts.select("pk", "length").filter(F.col("length") < size)
    done = parts.filter(F.col("length") >= size).select("pk", (-F.col("pk") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    schema = "block bigint, island int, pk bigint, length bigint, bin int, bins int, fit double"

    def island(key: tuple, pdf: pd.DataFrame, rnd: int, epoch: int) -> pd.DataFrame:
        b, isl = int(key[0]), int(key[1])
        rng = random.Random(f"{b}/{isl}/{rnd}/{epoch}")
        if epoch == 0:
            pdf = pdf.sort_values("pk", ignore_index=True)
            seeds = []
        else:
            pdf = pdf.sort_values(["origin", "pk"], ignore_index=True)
            seeds = []
            for _, own in pdf.groupby("origin"):
                got: dict[int, list[int]] = {}
                for k, v in enumerate(own["bin"].tolist()):
                    got.setdefault(v, []).append(k)
                seeds.append(list(got.values()))
            pdf = pdf[pdf["origin"] == pdf["origin"].iloc[0]].reset_index(drop=True)
        best = evolve(pdf["length"].tolist(), size, seeds, rng, population, generations)
        where = np.zeros(len(pdf), np.int32)
        for k, items in enumerate(best.bins):
            where[items] = k
        n, fit = best.fitness()
        return pd.DataFrame({"block": b, "island": isl, "pk": pdf["pk"], "length": pdf["length"], "bin": where, "bins": n, "fit": fit})

    def epochs(rnd: int, epoch: int) -> Callable:
        def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return island(key, pdf, rnd, epoch)

        return fn

    finished = []
    for rnd in range(rounds):
        n = todo.count()
        if not n:
            break
        blocks = -(-n // block)
        last = rnd == rounds - 1 or blocks == 1
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("pk", F.lit(rnd)), F.lit(blocks))).withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
        tasks = min(blocks * islands, MAX_TASKS)
        one = dealt.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(epochs(rnd, 0), schema)
        # the elite of each island stays and also moves on to the next one
        moved = one.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands)))
        two = moved.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(epochs(rnd, 1), schema)
        by_block = Window.partitionBy("block")
        win = two.withColumn("w", F.min(F.struct("bins", "fit", "island")).over(by_block)).filter(F.col("w.island") == F.col("island"))
        in_bin = Window.partitionBy("block", "bin")
        win = win.withColumn("fill", F.sum("length").over(in_bin)).withColumn("offset", F.sum("length").over(in_bin.orderBy("pk").rowsBetween(Window.unboundedPreceding, -1)))
        win = materialize(win.select("pk", "length", "block", "bin", "fill", F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset")), "pack")
        good = F.lit(True) if last else F.col("fill") >= size - slack
        finished.append(win.filter(good).select("pk", (((F.col("block") * rounds + rnd) * (1 << 20)) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        todo = win.filter(~good).select("pk", "length")
    for f in finished:
        done = done.unionByName(f)
    return done


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, **ga: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = materialize(pieces(df, tokenizer, id_col, text_col, size, end_id).withColumn("pk", F.monotonically_increasing_id()), "pieces")
    out = parts.join(pack(parts, size, **ga), "pk")
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
