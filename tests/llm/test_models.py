"""Quality, language, personal data, toxicity: held-out accuracy and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, pii, quality, queries, toxicity
from corpusloom.llm.common import bounded_sample, carried, join_skewed, learn_rows
from tests.llm.fixtures import documents, frame

SMALL = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def auc(y, x):
    r = pd.Series(x).rank().to_numpy()
    p = y == 1
    return (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def held_out(spark, name, mod, held):
    got = queries.queries()[name](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert all(h == (zlib.crc32(str(i).encode()) % mod == held) for i, h in zip(got.doc_id, got.held_out, strict=True))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    return got[got.held_out].merge(docs, on="doc_id").merge(labels, on="doc_id", how="left")


def test_quality_held_out(spark):
    h = held_out(spark, "op4_quality", 3, 1).dropna(subset=["quality"])
    assert auc(h.quality.to_numpy(), h.score.to_numpy()) > 0.95
    assert h.score.between(0, 1).all() and ((h.score >= 0.5) == (h.predicted == 1)).all()


def test_language_held_out(spark):
    h = held_out(spark, "op6_language_id", 5, 0)
    assert (h.lang == h.lang_pred).mean() > 0.97 and h.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    """By language, on the larger table, which has enough toxic texts of each to learn from."""
    got = queries.queries()["op9_toxicity"](spark, LARGE).toPandas()
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang").toPandas()
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    h = got[got.held_out].merge(docs, on="doc_id").merge(labels, on="doc_id")
    for lang, g in h.groupby("lang"):
        assert g[g.toxic == 1].predicted.mean() >= 0.9, lang
        assert g[g.toxic == 0].predicted.mean() <= 0.02, lang
        assert auc(g.toxic.to_numpy(), g.score.to_numpy()) > 0.95, lang


def test_terms_that_count_twice():
    lex = toxicity.Lexicon({"réeux*": 4.0, "idiot": 3.0}, twice=frozenset(["réeux*"]))
    assert lex.evidence("réeuxment là")[2] == 0 < lex.evidence("réeuxment. là réeuxaux")[2]
    assert toxicity.terms_of("Abcde abcdef x") == {"abcde": 1, "abcdef": 1, "x": 1, "abcd*": 2, "abcde*": 1}
    assert toxicity.thin({"abcd*": (10, 4.0), "abcde*": (10, 4.0), "abcdef": (3, 4.0), "xyz": (5, 3.5)}) == {"abcde*": 4.0, "xyz": 3.5}
    assert toxicity.thin({"abcd*": (20, 4.0), "abcde*": (10, 4.0), "abcdf": (9, 4.0)}) == {"abcd*": 4.0}


@pytest.mark.parametrize("plain,denied,quoted", [("I will kill you", "I will not kill you", "he said I will kill you"), ("ich werde dich töten", "ich werde dich nicht töten", "er sagte ich werde dich töten"), ("je vais vous frapper", "je ne vais vous frapper", "il dit vous frapper"), ("voy a matar a usted", "nunca matar a usted", "dijo matar a usted")])
def test_threats_of_four_languages(plain, denied, quoted):
    lex = toxicity.Lexicon({})
    top = lambda t: lex.evidence(t)[2]
    assert top(plain) > top(denied) > 0 and top(plain) > top(quoted) > 0


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark).withColumn("score", F.lit("clash"))


def test_models_on_awkward_rows(spark, odd):
    n = len(documents())
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels, learn_rows("doc_id", 3, 1))
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    lang = langid.train(odd, learn_rows("doc_id", 5, 0))
    rows = langid.identify(odd, lang, carry=["doc_id", "text"]).collect()
    assert len(rows) == n
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    lex = toxicity.learn_lexicon(odd, labels, learn_rows("doc_id", 4, 2))
    rows = toxicity.score_toxicity(odd, lex, carry=["doc_id", "text"]).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)


def test_clashing_and_repeated_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)] * 2, "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd, quality.train(odd, labels, learn_rows("doc_id", 3, 1)), carry=["doc_id", "score"]).collect()
    assert all(r.score_in == "clash" and 0 <= r.score <= 1 for r in got)
    got = langid.identify(odd, langid.train(odd, learn_rows("doc_id", 5, 0)), carry=["doc_id", "score"]).collect()
    assert all(r.score_in == "clash" for r in got)
    got = toxicity.score_toxicity(odd, toxicity.learn_lexicon(odd, labels, learn_rows("doc_id", 4, 2)), carry=["doc_id", "score"]).collect()
    assert all(r.score_in == "clash" for r in got) and len(got) == len(documents())
    twice = [r.score for r in got if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_samples_and_names(spark):
    df = spark.createDataFrame([(k % 3000, "a" if k < 8000 else "b") for k in range(9000)], "i long, g string")
    got = bounded_sample(df, "g", 500).collect()
    n = {g: sum(r.g == g for r in got) for g in "ab"}
    assert len(set(got)) == len(got) and 100 < n["a"] < 300 and 400 < n["b"] < 600
    assert bounded_sample(df.limit(0), "g", 5).count() == 0
    row = spark.createDataFrame([(1, 2, 3)], "x int, y int, y_in int").select(F.struct("x", "y", "y_in").alias("r"))
    assert row.select(*carried("r", ["x", "y", "y_in"], ("y", "z"))).columns == ["x", "y_in_in", "y_in"]


def test_join_skewed_equals_a_plain_join(spark):
    rows = spark.createDataFrame([(0 if k < 500 else k, k) for k in range(900)], "u long, v long")
    keyed = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    want = sorted((r.u, r.v, r.m) for r in rows.join(keyed, "u").collect())
    for total in (900, 9_000_000):
        assert sorted((r.u, r.v, r.m) for r in join_skewed(rows, keyed, ["u"], "c", total).collect()) == want


def test_models_on_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(none, quality.train(none, labels, learn_rows("doc_id", 3, 1))).count() == 0
    some = frame(spark).select("doc_id", "text")
    assert {r.score for r in quality.score_quality(some, quality.train(none, labels, learn_rows("doc_id", 3, 1))).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(some, langid.train(none, learn_rows("doc_id", 5, 0))).collect()} == {"und"}
    assert toxicity.score_toxicity(none, toxicity.learn_lexicon(none, labels, learn_rows("doc_id", 4, 2))).count() == 0
    assert pii.digest(pii.find_pii(none)).count() == 0


def test_grammar_tells_targets_negation_and_reports():
    lex = toxicity.Lexicon({"idiot": 3.0, "achlich*": 3.0})
    top = lambda t: lex.evidence(t)[2]
    assert top("you are an idiot") > top("an idiot") > top("he said an idiot") > 0
    assert top("you are not an idiot") < top("you are an idiot")
    assert top("I will kill you") > top("to kill time") > top("nice day") == 0
    assert top("achlichkeit") > 0 and top("achkeit") == 0
    auto = lex.automaton()
    assert lex.score("You are an IDIOT.", auto) > lex.score("a fine day", auto) == lex.score(None, auto) == lex.score("", auto)


def test_composed_machine_equals_the_chain():
    rng = random.Random(2)
    chain = (toxicity.report(), toxicity.negation(), toxicity.target(), toxicity.threat(), toxicity.insult())
    one = toxicity.grammar()
    for _ in range(300):
        word = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(0, 12))]
        states, total = [0] * len(chain), 0.0
        for s in word:
            for k, m in enumerate(chain):
                states[k], s, w = m.go(states[k], s)
                total += w
        state, got = 0, 0.0
        for s in word:
            state, _, w = one.go(state, s)
            got += w
        assert abs(got - total) < 1e-9


RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = {}
    for kind, rx in RX.items():
        out[kind] = []
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]
            if ok():
                out[kind].append(m.span())
    return out


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    parts = ["1", "2", "55", "255", "256", ".", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4111111111111111", "_", "%", "é", "\n"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("9" * 50_000 + "a" * 50_000 + "@")["email"] == []


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    labels = ["O", "B-x", "I-x"]
    crf = pii.Crf(labels, np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    batch = [rng.normal(size=(n, 3)) for n in (1, 2, 5, 3)]
    for e, path in zip(batch, crf.viterbi(batch), strict=True):
        best = max(np.ndindex(*[3] * len(e)), key=lambda p: crf.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(crf.trans[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(path) == best


def test_pii_query(spark):
    rows = [(1, "write to a.b@c.example.org or +1 (415) 555-2671 now"), (2, None), (3, ""), (4, "the password=e3b3ed3cc85f45 in 10.0.0.1"), (5, "nothing here"), (5, "nothing here"), (None, "4111 1111 1111 1111 é")]
    got = pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_email, by[1].n_phone, by[4].n_ip, by[None].n_card) == (1, 1, 1, 1)
    assert by[2].spans == by[3].spans == by[5].spans == ""
    assert by[4].spans.startswith("ip:") and "secret:" in by[4].spans


def test_near_copies_are_told_by_words_of_any_script(spark):
    words = ["дурак", "погода", "сегодня", "хорошая", "книга", "город", "улица", "река", "лес", "зима"]
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(30)] + ["!!!", "???", "...", "!!!"] + ["the same words in one text again"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, F.lit(True), "doc_id", "text", "toxic", 4000).collect()
    # near copies among the random texts are not wanted here, so each has its own words
    assert sorted(r.t for r in got) == sorted(set(texts))


def marked(row):
    """The text of a labelled row and its spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"<<(\w+)\|(.*?)>>", row):
        text += row[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + row[at:], spans


def test_held_out_rows_are_found_by_kind(spark):
    """Rows with values that the field wasn't trained on, set into texts of another kind."""
    rng = random.Random(11)
    rows, want = [], {}
    for k, row in enumerate(pii.labelled_rows(seed=99, copies=4)):
        text, spans = marked(row)
        front = " ".join(rng.choice(["reonth", "Thionde", "queel", "üerbe", "12", "and"]) for _ in range(rng.randint(0, 9))) + " "
        rows.append((k, front + text))
        want[k] = {(kind, a + len(front), b + len(front)) for kind, a, b in spans}
    got = {r.doc_id: {tuple(x) for x in r.added} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in ("email", "phone", "secret", "account", "ssn"):
        gold = {(k, x) for k, v in want.items() for x in v if x[0] == kind}
        found = {(k, x) for k, v in got.items() for x in v if x[0] == kind}
        assert len(gold & found) >= 0.9 * len(gold), kind
        assert len(gold & found) >= 0.9 * len(found), kind


def test_planted_secrets_are_found_and_digests_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.queries()["op7_pii"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    planted = 0
    for r in got:
        t = texts[r.doc_id]
        base = brute_pii(t)
        line = ",".join(f"{k}:{a}:{b}" for k in RX for a, b in sorted(base[k]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in RX]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        order = list(RX) + sorted({k for k, _, _ in spans} - set(RX))
        assert spans == sorted(spans, key=lambda x: (order.index(x[0]), x[1])) and len(spans) == r.n_spans
        assert {(k, a, b) for k in RX for a, b in base[k]} <= set(spans)
        keys = {("secret", m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
        planted += len(keys)
        assert keys == {x for x in spans if x[0] == "secret"} and r.n_secret == len(keys)
    assert planted > 5


def test_long_lines_and_many_spans():
    crf = pii.train_crf()
    one = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y; '
    text = one * 3000 + "word " * 200_000 + "info(at)shop.example.net " + "7 " * 30_000
    got = pii.field_spans([text], crf)[0]
    assert sum(k == "secret" for k, _, _ in got) >= 2990 and ("email", text.index("info"), text.index("net") + 3) in got
    assert max(len(s) for s in pii.segments(text)) <= pii.LONGEST
    own = [("ip", k, k + 2) for k in range(0, 100_000, 10)]
    assert len(pii.apart([("x", k, k + 1) for k in range(1, 100_000, 5)], own)) == 10_000
    assert pii.field_spans(["", "\n\n", "9"], crf) == [[], [], []]


def test_pii_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.c", "x", "y")], "doc_id long, text string, base string, n_email string")
    got = pii.find_pii(df, carry=["doc_id", "base", "text"]).first()
    assert (got.base_in, got.text, len(got.base)) == ("x", "mail a@b.c", 1)
    assert pii.digest(pii.find_pii(df)).first().n_email == 1


def test_obfuscated_addresses_without_digits():
    crf = pii.train_crf()
    for own in ("info(at)shop.example.net", "max.muster [at] post.example.org", "first.middle.last.more(at)a.b.c.example.net"):
        for text in (f"mail {own} please", f"a line\nwrite to {own} for more\nanother"):
            assert [(k, text[a:b]) for k, a, b in pii.field_spans([text], crf)[0]] == [("email", own)], text
    for text in ("we met at noon", "look at it (at home)", "the key to it", "monkey: a film", "nothing here"):
        assert not pii.TRIGGER.search(text) and not list(pii.segments(text)), text


@pytest.mark.parametrize("text", ["api_key = sesameopen", "access_token=sesameopen", "CLIENT_SECRET: sesameopen", '"key": "sesameopen"', "my_password=sesameopen", "mail sesameopen at shop.example.net"])
def test_cues_open_a_segment(text):
    assert "sesameopen" in [m.group() for seg in pii.segments(text) for m in seg]
