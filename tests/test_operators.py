from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.operators import batching, codec, matching, markup, symbols, words
from corpusloom.plans.ordered import ordered
from corpusloom.sources import tables
from corpusloom.streaming import online

HARD = ["", "a", "aaaa", "no line feed", "\x03\x05", "{a}{{b}}{{{c}}}[d][[e]]&&&", "&amp;lt;&lt;", "&#300;&#65;", "😀é", '"<>&&amp;&quot;\x03q\x03e"', "a&b &lt &gt; <"]


@pytest.mark.parametrize("text", HARD)
def test_codec_round_trip(text):
    raw = text.encode()
    assert codec.decode(codec.encode(raw), len(raw)) == raw


def test_codec_random_bytes_and_size():
    rng = random.Random(2)
    for _ in range(60):
        raw = bytes(rng.choice((0, 255, 7, rng.randrange(256))) for _ in range(rng.randint(0, 400)))
        assert codec.decode(codec.encode(raw), len(raw)) == raw
    raw = b"the cat sat on the mat " * 200
    assert len(codec.encode(raw)) < len(raw) // 3


def test_markup_inverses(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    got = df.select("t", markup.escape(markup.unescape(F.col("t"))).alias("a"), markup.swap_runs(markup.swap_runs(F.col("t"))).alias("b"), F.translate(F.translate("t", markup.FROM, markup.TO), markup.FROM, markup.TO).alias("c"))
    for r in got.collect():
        assert r.a == r.t and r.b == r.t and r.c == r.t


def test_ordered_equals_plain_order(spark):
    rng = random.Random(1)
    keys = rng.sample(range(100_000), 500)
    df = spark.createDataFrame([(k, k % 7, k % 3) for k in keys], "k long, x long, s long")
    rows = sorted(ordered(df, "k", add=F.col("x"), section=F.col("s")).collect(), key=lambda r: r.pos)
    assert [r.k for r in rows] == sorted(keys, key=lambda k: (k % 3, k))
    upto = 0
    for r in rows:
        assert r.before == upto
        upto += r.x


def test_gram_matches_by_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        cp = symbols.code_points(t)
        seen, n, hit = {}, 0, 0
        for i in range(len(t) - 8):
            g = t[i : i + 8]
            if g in seen:
                n += 1
                hit += t[seen[g] + 8] == t[i + 8]
            seen[g] = i
        assert matching.donor_hits(cp) == (n, hit)


def test_order_k_bits_by_stepping():
    t = "abracadabra abracadabra"
    seen, bits = {}, 0.0
    for i, c in enumerate(t):
        ctx = t[i - 1] if i else ""
        own = seen.setdefault(ctx, {})
        bits -= math.log2((own.get(c, 0) + 1) / (sum(own.values()) + 256))
        own[c] = own.get(c, 0) + 1
    assert abs(symbols.order_k_bits(symbols.code_points(t), 1) - bits) < 1e-9


def test_numeric_functions(spark):
    r = spark.createDataFrame([([1.0, -2.0, 3.0, 0.5],)], "e array<double>").select(
        N.rms_norm(F.col("e")).alias("r"), N.softmax(F.col("e")).alias("s"), N.layer_norm(F.col("e")).alias("l"), N.dot(F.col("e"), F.col("e")).alias("d"), N.rope(F.col("e"), F.lit(0)).alias("o"), N.stretch(N.logistic(F.lit(1.25))).alias("x")
    ).first()
    e = np.array([1.0, -2.0, 3.0, 0.5])
    assert np.allclose(r.r, e / np.sqrt((e**2).mean() + 1e-6))
    assert abs(sum(r.s) - 1) < 1e-12 and abs(sum(r.l)) < 1e-9
    assert abs(r.d - (e @ e)) < 1e-12 and np.allclose(r.o, e) and abs(r.x - 1.25) < 1e-9


def test_half_rows(spark, tmp_path):
    x = np.array([[0.1, 0.2], [1e-6, 65504.0]], np.float32)
    (tmp_path / "p").write_bytes(x.astype("<f2").tobytes())
    rows = tables.read_half_rows(spark, str(tmp_path / "p"), 2).orderBy("pos").collect()
    assert np.allclose([r.p for r in rows], x, rtol=1e-2, atol=1e-6)
    with pytest.raises(Exception, match="half floats"):
        tables.read_half_rows(spark, str(tmp_path / "p"), 3).collect()
    one = spark.createDataFrame([([0.5, 2.0],)], "p array<float>").select(tables.to_half("p").alias("h")).first()
    assert bytes(one.h) == np.array([0.5, 2.0], "<f2").tobytes()


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("hopping", "hop"), ("relational", "relat"), ("cats", "cat"), ("happiness", "happi"), ("by", "by")])
def test_stems(word, stem):
    assert words.stem(word)[0] == stem


def test_online_mean_equals_batch(spark, sf_dir, tmp_path):
    events = tables.table(spark, sf_dir, "events").select("user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def keep(df, _):
        out.update({r.user_id: (r.n, r["mean"]) for r in df.collect()})

    online.online_mean(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = {r.user_id: (r.n, r.m) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()}
    assert out.keys() == want.keys()
    assert all(out[k][0] == want[k][0] and abs(out[k][1] - want[k][1]) < 1e-9 for k in want)


def next_fit(lengths, limit):
    bin_, end, out = 0, 0, []
    for n in lengths:
        if end + n > limit:
            bin_, end = bin_ + 1, 0
        out.append((bin_, end))
        end += n
    return out


def test_next_fit_places_every_character_in_one_order(spark, tmp_path):
    rng = random.Random(9)
    # blocks of ids with gaps, a block smaller than a bin, long, empty and null texts
    ids = [*range(-3, 40), *range(4090, 4100), *range(9000, 9003), *range(20_000, 20_030)]
    size = {k: rng.choice((0, 1, 700, 2047, 2048, 2049, 6000, 8192, 8193, 30_000)) for k in ids}
    size |= {9000: 3, 9001: 0, 9002: 5}
    rows = [(k, None if k == 1 else "x" * size[k]) for k in ids]
    size[1] = 0
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.piece, r.length, r.bin, r.start) for r in batching.next_fit_pieces(spark, str(tmp_path)).collect())
    want = [(k, p, min(2048, size[k] - p * 2048)) for k in ids for p in range(max(1, -(-size[k] // 2048)))]
    assert got == [(*w, *at) for w, at in zip(want, next_fit([w[2] for w in want], 8192), strict=True)]
    assert sum(r[2] for r in got) == sum(size.values())


def test_affixes_use_every_word_with_a_code(spark, tmp_path):
    # more words than the short dictionary holds, by falling counts: (a) in it, (b) beyond 4000, (c) without a code
    def name(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(4))

    filler = [f"{name(k)}fill" for k in range(words.ONE + words.TWO + words.THREE - 2)]
    text = " ".join(["holiday holiday holiday holiday", *(f"{x} {x} {x}" for x in filler), "mountain mountain", "xmountain qholidayq preholiday mountains unknownword"])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.kind, r.affix) for r in words.affix_match(spark, str(tmp_path)).collect()}
    assert got == {"xmountain": ("suffix", "mountain"), "preholiday": ("suffix", "holiday"), "mountains": ("prefix", "mountain")}
    codes = {r.word for r in words.dictionary_codes(spark, str(tmp_path)).collect()}
    assert "mountain" in codes and not codes & set(got)
