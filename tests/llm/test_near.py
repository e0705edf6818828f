"""N-gram join, suffix dedup, the pipeline: against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join, suffix_dedup
from corpusloom.llm.common import WORD_TABLE
from corpusloom.llm.components import components
from tests.llm.fixtures import documents, frame
from tests.llm.test_exact import brute_dedup, brute_hits


def shingles(t):
    w = (t or "").encode().translate(WORD_TABLE).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    links, top = [0] * n, list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(n):
            both = len(sets[i] & sets[j])
            if i != j and sets[i] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    groups = [find(i) for i in range(n)]
    least = {}
    for i in range(n):
        k = (rows[i][0] is None, rows[i][0] or 0)
        least[groups[i]] = min(least.get(groups[i], k), k)
    return Counter((rows[i][0], links[i], None if least[groups[i]][0] else least[groups[i]][1]) for i in range(n)), len(set(groups))


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join(spark, block):
    rows = documents()
    got = ngram_join.ngram_join(frame(spark, rows).withColumn("class_id", F.lit("clash")), block=block).collect()
    want, _ = brute_join(rows)
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == want


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = documents()
    got = ngram_join.near_dedup(frame(spark, rows)).collect()
    _, groups = brute_join([r for r in rows if shingles(r[1])])
    texts = [r for r in got if shingles(r.text)]
    assert len(texts) == groups
    blank = {(r[0], r[1]) for r in rows if not shingles(r[1])}
    assert Counter((r.doc_id, r.text) for r in got if not shingles(r.text)) == Counter(blank)
    assert ngram_join.near_dedup(frame(spark, [])).count() == 0
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 120
    assert 1 - (1 - 0.85**rows) ** bands >= 1 - 1 / 200_000


def test_threshold_in_whole_numbers():
    inter = np.array([[8.0, 7.0], [4.0, 0.0]])
    got = ngram_join.similar(inter, np.array([9, 5]), np.array([9, 9]), 0.8)
    assert got.tolist() == [[True, False], [False, False]]
    assert ngram_join.similar(np.array([[4.0]]), np.array([4]), np.array([5]), 0.8).all()


def test_recall_by_similarity(spark):
    """Links of the generated table by brute force over an inverted index: each class's links, and none more."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = [shingles(t) for _, t in rows]
    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    both = Counter()
    for k in where.values():
        if 1 < len(k) < 200:
            both.update((a, b) for i, a in enumerate(k) for b in k[i + 1 :])
    links, steps = Counter(), Counter()
    for (a, b), n in both.items():
        u = len(sets[a]) + len(sets[b]) - n
        if 5 * n >= 4 * u:
            links[rows[a][0]] += 1
            links[rows[b][0]] += 1
            steps[int(20 * n / u)] += 1
    assert sum(steps.values()) > 100 and max(len(k) for k in where.values()) < 200
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v} == dict(links)


def test_join_of_a_hot_class(spark):
    """A text with very many copies, and a large group of near copies, cut into blocks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 420):
        w = list(base)
        w[rng.randrange(60)] = f"x{rng.randrange(3)}"
        rows.append((k, " ".join(w)))
    want, _ = brute_join(rows)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == want


def test_intersections():
    rng = np.random.default_rng(3)
    a = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(70)]
    b = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(50)]
    want = np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])
    for dense in (0, 4, 48):
        assert (ngram_join.intersections(a, b, dense) == want).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_suffix_array():
    rng = random.Random(7)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 9])
        s = np.array([rng.randrange(k) for _ in range(rng.randint(1, 50))])
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_suffix(rows, width=100):
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for none, i, t in order:
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                cover[k : k + width] = b"\1" * width
            seen.add(w)
        runs = sum(1 for k, m in enumerate(cover) if m and (k == 0 or not cover[k - 1]))
        kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        out[None if none else i, t] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"most": 2, "hot": 3}])
@pytest.mark.parametrize("kind", ["awkward", "passage"])
def test_suffix_dedup(spark, how, kind):
    rows = documents()
    if kind == "passage":
        # one passage in many texts and several times within a text, at any place; long runs of one letter
        rng = random.Random(12)
        passage = "".join(rng.choice("abcd e") for _ in range(230))
        rows = [(k, "".join(rng.choice("fghi j") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 60) :] * rng.randint(1, 3), "en", "s", 1) for k in range(60)]
        rows += [(100, "é" * 400, "fr", "s", 1), (101, "xy" * 700, "en", "s", 1), (102, passage + "xy" * 60, "en", "s", 1)]
        rows += rows[:9]
    df = frame(spark, rows).withColumns({"removed": F.lit("own"), "n_bytes": F.lit("own")})
    assert suffix_dedup.suffix_dedup(df.limit(3), carry=["doc_id", "removed"]).first().removed_in == "own"
    got = suffix_dedup.suffix_dedup(df, carry=["doc_id", "text"], **how).collect()
    want = brute_suffix(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, r.text or ""], r.doc_id
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_first_places_in_any_batches():
    """Rows cut into batches anywhere give what one batch gives."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(5), rng.choice([0, 0, 1]), rng.randrange(3), k, rng.randrange(2)) for k in range(40) for _ in range(rng.randint(1, 2)))
    names = ["id", "doc", "lo", "n", "g", "sig", "salt"]

    def batch(part):
        cols = [[r[3] for r in part], [r[3] for r in part], [r[4] for r in part], [5] * len(part), [r[0] for r in part], [r[2] for r in part], [r[1] for r in part]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(sizes):
        parts, at = [], 0
        while at < len(rows):
            n = rng.choice(sizes)
            parts.append(batch(rows[at : at + n]))
            at += n
        return Counter(tuple(r.values()) for b in suffix_dedup.first_places(iter(parts), 100) for r in b.to_pylist())

    whole = run([1000])
    assert whole and all(run([1, 2, 3, 7]) == whole for _ in range(20))


def test_packed_counts(spark):
    """Counts of hashes that are reduced before the shuffle equal plain counts."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)
    h = rng.choice(h, 5000)
    rows = [b for part in np.array_split(h, 7) for b in suffix_dedup.deal(part, 8)]
    packed = spark.createDataFrame(pa.Table.from_batches(rows).to_pandas(), suffix_dedup.PACKED)
    filters = suffix_dedup.gather_filters(packed, 22, 8, (1, 15, 20))
    known, n = np.unique(h, return_counts=True)
    for f, least in zip(filters, (1, 15, 20), strict=True):
        assert f.has(known[n >= least]).all() and not f.has(known[n < least]).any()


def test_anchors_of_a_long_text_in_parts():
    rng = random.Random(9)
    raw = np.frombuffer(bytes(rng.randrange(4) + 97 for _ in range(5000)), np.uint8)
    a = suffix_dedup.anchors(raw, np.array([0, 5000]), suffix_dedup.HASHER)
    windows = (a.hi - a.lo + 1).sum()
    assert windows == 5000 - 99 and (a.lo <= a.at).all() and (a.at + 32 <= a.lo + 100 + (a.hi - a.lo)).all()


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert not set(rows) - set(before.collect())
        docs = spark.createDataFrame(rows, before.schema)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    texts = [r.text for r in docs.collect()]
    assert brute_join([(k, t) for k, t in enumerate(texts)])[1] == len(texts)
    packed = p.packing(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(texts)
    assert docs.limit(0).count() == 0 and p.exact_dedup(spark, docs.limit(0), sf_dir).count() == 0


CLASHING = ("predicted", "score", "kept", "keep_id", "contaminated", "n_hit", "comp", "length", "removed")


@pytest.fixture(scope="module")
def own_tables(spark, tmp_path_factory):
    """Labels and a benchmark for the awkward documents."""
    folder = str(tmp_path_factory.mktemp("own"))
    rows = documents()
    spark.createDataFrame([(k, k % 2, int(k in (3, 9))) for k in range(1, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, rows[5][1]), (2, " ".join((rows[45][1]).split()[22:40])), (None, rows[7][1]), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, items


def test_pipeline_stages_by_brute_force(spark, own_tables):
    """Null ids and texts, blanks, a long text, repeated rows and clashing names, stage by stage."""
    import corpus_pipeline as p

    folder, items = own_tables
    docs = frame(spark).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    plain = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = Counter((r.doc_id, r.text) for r in rows)
        assert not after - Counter(before)
        if name == "exact_dedup":
            _, winners = brute_dedup(before)
            assert sorted(str(i) for i, _ in after) == sorted(str(None if w[1] else w[2]) for w in winners.values())
        if name == "ngram_jaccard_join":
            assert brute_join(list(after))[1] == len(after) == brute_join(before)[1]
        if name == "decontamination":
            assert after == Counter(x for x in before if not brute_hits(x[1], items)[4])
            assert sum(after.values()) < len(before)
        docs = spark.createDataFrame(rows, docs.schema)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(p.tokenizer_path())
    packed = p.packing(spark, docs, folder).collect()
    want = Counter({i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in plain(docs)})
    have: Counter = Counter()
    for r in packed:
        have[r.doc_id] += r.length
    assert have == want
    for s in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_pipeline_on_empty_tables_and_whole(spark, own_tables):
    import corpus_pipeline as p

    folder, _ = own_tables
    none = frame(spark, []).withColumns({c: F.lit("x") for c in CLASHING})
    for _, stage in p.STAGES:
        assert stage(spark, none, folder).count() == 0
    assert p.run(spark, folder).count() > 10
