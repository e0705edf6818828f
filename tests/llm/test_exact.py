"""URL filter, exact dedup, decontamination, packing: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import packing
from corpusloom.llm.decontam import decontaminate
from corpusloom.llm.exact_dedup import content_sort_dedup
from corpusloom.llm.queries import tokenizer_path
from corpusloom.llm.url_filter import RULES, Rule, ShiftAnd, judge_urls
from tests.llm.fixtures import documents, frame


def glob_rx(glob: str) -> str:
    return "".join({"*": "[^/]*", "?": "."}.get(x, ".*" if x == "**" else re.escape(x)) for x in re.findall(r"\*\*+|.", glob, re.S))


def test_shift_and_equals_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    auto = ShiftAnd(globs)
    assert auto.words > 1
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))) for _ in range(200)]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *map(len, texts)])
    got = auto.match(np.frombuffer(raw, np.uint8), off)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(re.fullmatch(glob_rx(g), t, re.S)), (t, g)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/es/x", "http://example.org/en/1", "http://a.example.org/en/2?x=/es/", "https://x.com/fr/", "http://x.com/de/1#top", "http://x.com", "http://x.com?/de/", "http://notorg/", "http://org/", "http://b.net/x.org/", "s://h/é/" + "p" * 5000, "http://best-pills.net/", "http://x.com/fr", "a://b://c.org/"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate([*urls, urls[4]])], "page_id long, url string, rule string")
    rows = judge_urls(df).orderBy("page_id").collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.text)
        assert r.verdict == (best.verdict if best else "block" if "-pills." in host and path else "allow")
    assert judge_urls(df.limit(0)).count() == 0
    other = judge_urls(df, rules=(Rule("x.com", "/", "block"),), globs=(), default="maybe").filter("page_id = 1").first()
    assert other.verdict == "maybe"


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k, i))
    out = {}
    for norm, g in groups.items():
        g.sort(key=lambda x: x[:4])
        for x in g:
            out.setdefault((x[4], rows[x[3]][1]), []).append((g[0][4], len(g), hashlib.sha256(norm.encode()).hexdigest()))
    return out, {norm: g[0] for norm, g in groups.items()}


@pytest.mark.parametrize("copies", [0, 400])
def test_exact_dedup(spark, copies):
    rows = documents() + [(5000 + k, "hot text" + " " * (k % 5), "en", "s", 1) for k in range(copies)]
    got = content_sort_dedup(frame(spark, rows), carry=["doc_id", "text", "lang"]).collect()
    want, winners = brute_dedup(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id, r.text][0]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(winners)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((w[1], w[2]) for w in winners.values())
    assert content_sort_dedup(frame(spark, [])).count() == 0


def brute_hits(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w = split(text)
    hit, who = set(), set()
    for k, t in items:
        x = split(t)
        for i in range(max(1, len(x) - width + 1) if x else 0):
            win = x[i : i + width]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    who.add("" if k is None else str(k))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("shard", [8 << 20, 900])
def test_decontamination(spark, shard):
    rows = documents()
    items = [(1, rows[45][1][40:260]), (2, rows[5][1]), (10, "É ü"), (11, "AN The OR"), (None, rows[7][1]), (12, None), (13, "..."), (2, rows[6][1])]
    df = frame(spark, rows).withColumns({"items": F.lit("clash"), "contaminated": F.lit("clash"), "n": F.lit(1), "key": F.lit("k")})
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard, carry=["doc_id", "text", "items", "contaminated", "key"], spans=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.items, r.contaminated_in, r.key) == ("clash", "clash", "k")
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(r.text, items)
        inside = [r.text[s.a : s.b] for s in r.spans]
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", s)) for s in inside) == r.n_hit
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(df, empty).filter("contaminated").count() == 0
    assert decontaminate(df.limit(0), empty).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(6)
    rows = documents() + [(9000 + k, "x " * rng.randint(1, 3000) + rng.choice(["it's", "Ωmega", "<|endoftext|>", "naïve 12", "\x1c"]), "en", "s", 1) for k in range(60)]
    rows = [r for r in rows if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = packing.pack_documents(frame(spark, rows), tokenizer_path(), block=16, islands=3).collect()
    by_doc, by_seq, total = defaultdict(list), defaultdict(list), 0
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            piece = ids[at : at + 4096]
            assert (r.start, r.length, r.ids_crc32) == (at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) <= -(-total // 4096) + 2
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).count() == 0
    twice = packing.pack_documents(frame(spark, [(1, None, "", "", 0)] * 3), tokenizer_path()).collect()
    assert [r.length for r in twice] == [1, 1, 1] and sorted(r.offset for r in twice) == [0, 1, 2]


def test_word_coder_equals_tokenizer():
    coder = packing.coder_of(tokenizer_path())
    assert coder.splits_here
    rng = random.Random(8)
    parts = ["don't", "I'M", "'s", "''s", "!'s", "we'll", "x'", "'re'", "é", "ÀÉ", "12", "3", "...", " ", "\n", "ab", "\t", "ß²", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", "漢字 😀", "a" * 9000]
    for t, ids in zip(texts, coder.encode_many(texts), strict=True):
        assert ids.tolist() == coder.whole(t).tolist(), t
