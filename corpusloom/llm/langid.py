"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of 2^bits slots, one bit per language. An
n-gram (4 bytes of the lower-cased text, all but letters blank) is looked up at
``hashes`` slots; the AND of the slots' masks has a bit for each language that
contains the n-gram. Each language's popcount over a text is corrected for its
filter's false positive rate f, (count - f n) / (1 - f), and related to what the
language's own texts reach. The largest decides; the score is its share.

Learning: from about ``bound`` documents of each language at most, chosen by a hash of
the text, whole texts. A language contains an n-gram if it uses it at a rate of at least
``share`` times that of the language that uses it most; nothing else is left out. The
slots grow with the n-grams between 2^LEAST_BITS and 2^MOST_BITS; a fuller filter has a
higher false positive rate, which the counts are corrected for.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing could be learned; texts are read whole; of tied languages the one
with more documents in the sample wins, then the lesser name; equal texts are learned
from once; repeated rows get a row and the same result each; an empty table gives an
empty result; a carried column that has the name of a result is renamed (see
``carried``), other extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded_sample, carried, map_text, slices
from corpusloom.session import materialize, release

BOUND = 1500
UNKNOWN = "und"
LEAST_BITS, MOST_BITS = 18, 24
#: Byte classes of the lower-cased text: ASCII letters and non-ASCII bytes stay, the rest is blank.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of all texts as numbers, and each text's end in them."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b"  " if t else b"   " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    code = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    code = np.append(code, np.zeros(3, np.uint32))
    ends = np.cumsum([len(x) for x in raw])
    own = np.ones(len(code), bool)
    for k in (1, 2, 3):
        own[ends - k] = False
    ends = np.cumsum(own)[ends - 1]
    return code[own], ends


@dataclass
class MaskFilter:
    langs: list[str]
    bits: int
    masks: np.ndarray  # words x slots
    false_rate: np.ndarray
    reach: np.ndarray

    def lookup(self, code: np.ndarray, w: int) -> np.ndarray:
        out = None
        for mul in (0x9E3779B1, 0x85EBCA6B):
            m = self.masks[w][(code * np.uint32(mul)) >> np.uint32(32 - self.bits)]
            out = m if out is None else out & m
        return out

    def counts(self, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts, texts x languages, and the n-grams of each text."""
        n = np.diff(ends, prepend=0)
        out = np.zeros((len(ends), len(self.langs)))
        for w in range(len(self.masks)):
            got = self.lookup(code, w)
            for b in range(min(64, len(self.langs) - 64 * w)):
                upto = np.concatenate([[0], np.cumsum((got >> got.dtype.type(b)) & got.dtype.type(1), dtype=np.int64)])
                out[:, 64 * w + b] = np.diff(upto[ends], prepend=0)
        return np.maximum(0.0, (out - n[:, None] * self.false_rate) / (1 - self.false_rate)), n

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        c, n = self.counts(*grams(texts))
        rel = c / np.maximum(1, n)[:, None] / self.reach
        total = rel.sum(1)
        best = rel.argmax(1)
        return best, np.clip(rel[np.arange(len(best)), best] / np.where(total > 0, total, 1), 0, 1)


def train(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", bound: int = BOUND, share: float = 0.2) -> MaskFilter:
    known = df.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    sample = materialize(bounded_sample(known, "l", bound), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for one in np.unique(langs):
                mine = [texts[k] for k in np.flatnonzero(langs == one)]
                for i, j in slices(np.array([len(t) for t in mine]), 4 << 20):
                    code, n = np.unique(grams(mine[i:j])[0], return_counts=True)
                    code, n = np.append(code, 0).astype(np.int64), np.append(n, j - i)  # n-gram 0 counts the texts
                    yield pa.RecordBatch.from_arrays([pa.array([str(one)] * len(code)), pa.array(code), pa.array(n.astype(np.int64))], names=["l", "g", "n"])

    got = sample.mapInArrow(count, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    rows = got.toPandas()
    release(sample)
    if not len(rows):
        return MaskFilter([], LEAST_BITS, np.zeros((1, 1 << LEAST_BITS), np.uint64), np.zeros(0), np.ones(0))
    docs = rows[rows["g"] == 0].set_index("l")["n"].to_dict()
    langs = sorted(docs, key=lambda k: (-docs[k], k))
    rows = rows[rows["g"] != 0].sort_values(["l", "n", "g"], ascending=[True, False, True])
    rows["rate"] = rows["n"] / rows.groupby("l")["n"].transform("sum")
    rows = rows[rows["rate"] >= share * rows.groupby("g")["rate"].transform("max")]
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * int(rows.groupby("l").size().max() if len(rows) else 0)).bit_length()))
    words = -(-len(langs) // 64)
    dtype = np.uint8 if len(langs) <= 8 else np.uint64
    masks = np.zeros((words, 1 << bits), dtype)
    for k, lang in enumerate(langs):
        code = rows.loc[rows["l"] == lang, "g"].to_numpy().astype(np.uint32)
        for mul in (0x9E3779B1, 0x85EBCA6B):
            masks[k // 64][(code * np.uint32(mul)) >> np.uint32(32 - bits)] |= dtype(1 << k % 64)
    fill = np.array([float(((masks[k // 64] >> dtype(k % 64)) & dtype(1)).mean()) for k in range(len(langs))])
    reach = np.array([max(1e-3, float(rows.loc[rows["l"] == lang, "rate"].sum())) for lang in langs])
    return MaskFilter(langs, bits, masks, np.minimum(0.9, fill**2), reach)


def identify(df: DataFrame, model: MaskFilter, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: doc_id) with lang_pred and score."""
    carry = ["doc_id"] if carry is None else carry
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    src = df.select(F.struct(*[F.col(c) for c in carry]).alias("__row"), letter.alias("__letter"), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema["__row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    known = df.sparkSession.sparkContext.broadcast(model)  # one word of 2^bits slots for each 64 languages

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, n = known.value, batch.num_rows
        some = np.array(batch.column(1).to_pylist(), bool)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if m.langs:
            texts = batch.column(2).to_pylist()
            for i, j in slices(np.array([len(t or "") for t in texts])):
                best, s = m.decide(texts[i:j])
                lang[i:j], score[i:j] = np.array(m.langs, object)[best], s
        lang[~some], score[~some] = UNKNOWN, 0.0
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["__row", "lang_pred", "score"])

    return map_text(src, fn, schema).select(*carried("__row", carry, ("lang_pred", "score")), "lang_pred", "score")
