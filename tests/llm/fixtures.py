"""Small document tables with the awkward cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    syllables = ["an", "the", "or", "ti", "ing", "es", "wh", "ble", "re", "st"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Plain texts, exact copies, near copies, a shared passage, null and empty texts, one long text, a repeated row."""
    rng = random.Random(seed)
    rows: list[str | None] = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    base = words(rng, 90)
    passage = words(rng, 60)
    for k in range(8):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        rows.append(" ".join(w))
    rows += [rows[0], rows[0] + "  ", " \t" + rows[1].replace(" ", "\n"), base, base]
    rows += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(4)]
    rows += [None, "", " \n", "a", "é ü", words(rng, 9000), "z" * 300, "ab" * 200]
    out = [(k + 1, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(rows)]
    return [*out, out[3], (None, rows[2], None, None, None), (None, None, None, None, 0)]


def frame(spark, rows: list[tuple] | None = None, schema: str = SCHEMA):
    return spark.createDataFrame(documents() if rows is None else rows, schema)
