from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import matching as M


def counted(texts):
    out = Counter()
    for t in texts:
        w = re.findall(rb"[a-z0-9]+", t or b"")
        out.update(b" ".join(w[k : k + 3]) for k in range(len(w) - 2))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 100, M.PIECE])
def test_patterns_of_pieces(size):
    texts = [b"", None, b"a", b"a b", b"a b c", b"--", b" a  b\xc3\xa9c d ", b"x" * 50, b"a b c d e", b"", b"q w", b"e r t", b"lorem ipsum dolor sit amet, " * 9]
    got, buckets = Counter(), {}
    for rows in (texts, texts[::-1], [], [None], [b""]):
        got.clear()
        for text, at, to, b in M.patterns_of(rows, size):
            for i, j, k in zip(at.tolist(), to.tolist(), b.tolist(), strict=True):
                got[text[i:j]] += 1
                assert buckets.setdefault(text[i:j], k) == k and 0 <= k < M.BUCKETS
        assert got == counted(rows)


def test_rare_patterns_stay_in_their_task():
    texts = [b"the cat sat on the mat " * 5, b"one two three four five six seven"]
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])])
    counts = np.concatenate([np.frombuffer(c, np.int64) for b in M.bucket_counts(batch()) for c in b.column(1).to_pylist()])
    assert sorted(counts[counts > 0]) == sorted(counted(texts).values())
    full = np.zeros(M.BUCKETS, bool)
    for *_, b in M.patterns_of(texts[:1]):
        full[b] = True

    class Chosen:
        value = full

    rows = {g: n for b in M.patterns_in(Chosen)(batch()) for g, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert rows == {g.decode(): n for g, n in counted(texts[:1]).items()}


@pytest.mark.parametrize("fullest", [M.FULLEST, 200, 1])
def test_frequent_patterns_are_whole(spark, tmp_path, monkeypatch, fullest):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 300) % 40) for _ in range(60)] + [None, "", "OneK two three", "one two"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(M, "FULLEST", fullest)  # the others are judged by the last of the fullest
    df = M.frequent_patterns(spark, str(tmp_path))
    want = sorted((-n, g.decode()) for g, n in counted([(t or "").lower().encode() for t in texts]).items())[:128]
    assert len(want) == 128 and [(-r.n, r.pattern) for r in df.collect()] == want
    assert "Generate" not in df._jdf.queryExecution().toString()


def test_few_or_no_patterns(spark, tmp_path):
    for name, rows in (("few", [(1, "a b c d"), (2, "a b c")]), ("none", [(1, "a b"), (2, None)]), ("empty", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [(r.pattern, r.n) for r in M.frequent_patterns(spark, f"{tmp_path}/{name}").collect()]
        assert got == ([("a b c", 2), ("b c d", 1)] if name == "few" else [])
