from __future__ import annotations

import random

import pytest

from corpusloom.operators import contexts as C

ALL = {**C.CONTEXTS, **C.LINE_CONTEXTS, **C.BRACKET_CONTEXTS}


@pytest.mark.parametrize("by_hash", [True, False])
def test_texts_sorted_together_have_the_hits_of_each(by_hash):
    rng = random.Random(3)
    words = ["the ", "cat", " is", " {a", "b} ", "\n", ". ", "12", "é漢", " <p>", "Of "]
    texts = ["x", "the the", "a\nb\nab"] + ["".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    fs = [C.Features(t) for t in texts]
    want = {}
    for name, key in ALL.items():
        each = [C.hits(f, key) for f in fs]
        want[name] = tuple(map(sum, zip(*each, strict=True)))
    assert C.pooled_hits(fs, ALL, by_hash) == want
    assert sum(n for n, _ in want.values()) > 1000
    assert [len(p) for p in C.pools(["x" * 40_000] * 3)] == [2, 1]


def test_texts_are_dealt_to_all_tasks(spark):
    from corpusloom.sources.tables import dealt

    one = spark.range(50).coalesce(1)
    assert dealt(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
