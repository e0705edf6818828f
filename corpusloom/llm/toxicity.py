"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, a clause into words, and each word has a class: insult,
threat, target, negation, report, or other. Five transducers rewrite the classes and
add weights:

* report: after a word of saying, an insult or threat of the clause is quoted;
* negation: an insult or threat within three words after a negation is denied;
* target: an insult beside a target (three words at most after it) is aimed;
* threat: a threat counts in full only if a target is in the clause before or after;
* insult: what is left of each mark gives its weight.

They are composed into one machine, which reads each clause that holds a mark.
Clauses add up to the text's evidence; three numbers of it (the sum, the strongest
clause, the marks per hundred words) go through a logistic curve.

The lexicon of insults is learned: words, and word beginnings of 4 to 8 letters
(``abcd*``), that far more toxic than clean texts hold; a term that clean texts hold
by chance too is one if it tells toxic texts once it occurs twice, and then counts only
in texts that hold it twice. Near copies among the sample count once, so that a copied
text does not make its own words suspect. The small fixed lists of the other classes
serve English, German, French and Spanish. Sample: about ``bound`` rows of each label,
chosen by a hash; the lexicon keeps every term of it that meets the limits. One
Aho-Corasick automaton over the lexicon finds the texts with marks; all others get the
score of a text without evidence.

Defined results: a null or empty text has no evidence; texts are read whole; repeated
rows get a row and the same score each, and an id that is repeated is learned from
once, by its least text; terms that tie stay all; with nothing to learn from only the
fixed lists count; an empty table gives an empty result; a carried column that has the
name of a result is renamed (see ``carried``), other extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import WORD_TABLE, bounded_sample, carried, map_text, one_text, row_and_text, texts_of
from corpusloom.session import materialize, release

BOUND = 4000
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PREFIXES = (4, 5, 6, 7, 8)

# fixed lists of the small classes
THREATS = (
    "kill", "hurt", "destroy", "shoot", "stab", "strangle", "burn", "beat", "hang", "punch",
    "töten", "töte", "umbringen", "schlagen", "verprügeln", "erschießen", "erstechen", "verbrennen", "vernichten", "erwürgen",
    "tuer", "tuerai", "frapper", "frapperai", "brûler", "étrangler", "poignarder", "détruire", "abattre", "massacrer",
    "matar", "mataré", "golpear", "golpearé", "quemar", "estrangular", "apuñalar", "destruir", "disparar", "ahorcar",
)
TARGETS = (
    "you", "your", "youre", "u", "he", "she", "they", "them", "him", "her", "those", "these", "people", "everyone",
    "du", "dich", "dir", "dein", "ihr", "euch", "sie", "alle",
    "tu", "te", "toi", "vous", "ils", "elle", "elles",
    "tú", "ti", "vosotros", "ellos", "ellas", "usted", "ustedes",
)
NEGATIONS = (
    "not", "no", "never", "isn", "aren", "wasn", "don", "won", "neither", "nor",
    "nicht", "kein", "keine", "keinen", "nie", "niemals",
    "ne", "pas", "jamais", "aucun", "aucune",
    "nunca", "jamás", "ningún", "ninguna", "tampoco",
)
REPORTS = (
    "said", "says", "wrote", "writes", "told", "called", "quote", "quoted", "reported", "claims",
    "sagte", "sagt", "schrieb", "schreibt", "nannte", "zitierte", "berichtete", "behauptet",
    "dit", "disait", "écrit", "écrivait", "appelé", "cité", "rapporte", "affirme",
    "dijo", "dice", "escribió", "escribe", "llamó", "citó", "informó", "afirma",
)

# classes: Insult, Threat, Y target, Negation, Report, Other; marks after rewriting: Quoted, Denied, Aimed, V aimed threat
SYMBOLS = "ITYNRO"


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight); a missing arc keeps the state and copies the symbol."""

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def go(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def report() -> Transducer:
    return Transducer({(0, "R"): (1, "R", 0.0), (1, "I"): (1, "Q", 0.0), (1, "T"): (1, "Q", 0.0)})


def negation(reach: int = 3) -> Transducer:
    arcs = {}
    for left in range(reach + 1):
        for s in "ITYROQ":
            out = "D" if left and s in "IT" else s
            arcs[left, s] = (max(0, left - 1), out, 0.0)
        arcs[left, "N"] = (reach, "N", 0.0)
    return Transducer(arcs)


def target(reach: int = 3) -> Transducer:
    arcs = {}
    for left in range(reach + 1):
        for s in "ITNROQD":
            out = "A" if left and s == "I" else "V" if left and s == "T" else s
            arcs[left, s] = (max(0, left - 1), out, 0.0)
        arcs[left, "Y"] = (reach, "Y", 0.0)
    return Transducer(arcs)


def threat() -> Transducer:
    """A threat without a target before it counts once a target follows in the clause."""
    return Transducer({(0, "T"): (1, "T", 0.0), (1, "Y"): (0, "V", 0.0)})


def insult() -> Transducer:
    weight = {"I": 1.0, "A": 1.5, "V": 1.5, "Q": 0.5, "D": 0.5, "T": 0.1}
    return Transducer({(0, s): (0, s, w) for s, w in weight.items()})


def compose(a: Transducer, b: Transducer, symbols: str = SYMBOLS) -> Transducer:
    """The machine that feeds a's output to b; pairs of states are numbered as they are reached."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        p, q = todo.pop()
        for s in symbols:
            p2, mid, w1 = a.go(p, s)
            q2, out, w2 = b.go(q, mid)
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            arcs[number[p, q], s] = (number[p2, q2], out, w1 + w2)
    return Transducer(arcs)


def grammar() -> Transducer:
    m = report()
    for nxt in (negation(), target(), threat(), insult()):
        m = compose(m, nxt)
    return m


def flat_words(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()) + b" "


@dataclass
class Lexicon:
    """Terms, their log odds and how often a text must hold them; a term that ends in * is a beginning."""

    insults: dict[str, float]
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 1.0, 0.0]))
    twice: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.words = {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS} | {w: "T" for w in THREATS}
        self.machine = grammar()
        self.threats = frozenset(THREATS)

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for t in [*self.insults, *THREATS]:
            raw = t.rstrip("*").encode().decode("latin-1")
            auto.add_word(f" {raw}" if t.endswith("*") else f" {raw} ", 1)
        auto.make_automaton()
        return auto

    def terms(self, word: str) -> list[str]:
        return [t for t in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)) if t in self.insults]

    def evidence(self, text: str) -> np.ndarray:
        """Log of the summed clause scores, the strongest clause, marks per hundred words."""
        clauses, held, words = [], Counter(), 0
        for clause in CLAUSE.split(text.lower()):
            tokens = WORD.findall(clause)
            words += len(tokens)
            own = [self.terms(w) for w in tokens]
            if any(own) or not self.threats.isdisjoint(tokens):
                clauses.append((tokens, own))
                held.update(t for o in own for t in o)
        total = top = marks = 0.0
        for tokens, own in clauses:
            odds = [max((self.insults[t] for t in o if t not in self.twice or held[t] > 1), default=0.0) for o in own]
            state, score = 0, 0.0
            for w, o in zip(tokens, odds, strict=True):
                state, _, gain = self.machine.go(state, "I" if o else self.words.get(w, "O"))
                score += gain * (o or 2.0)
                marks += bool(o)
            total += score
            top = max(top, score)
        return np.array([1.0, math.log1p(total), math.log1p(top), math.log1p(100 * marks / max(1.0, words))])

    def score(self, text: str | None, auto: ahocorasick.Automaton) -> float:
        x = np.array([1.0, 0.0, 0.0, 0.0])
        if text and next(auto.iter(flat_words(text).decode("latin-1")), None) is not None:
            x = self.evidence(text)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.curve @ x))))))


def terms_of(text: str) -> Counter:
    """Words and beginnings, and how often the text holds each."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        out[w] += n
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def labelled(df: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """About ``bound`` texts of either label at most, near copies once: (y, t)."""
    ids = bounded_sample(labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")), "y", bound)
    ids = materialize(ids, "labelled")  # about 2 x bound rows, which are broadcast
    rows = one_text(df, ids.withColumnRenamed("i", id_col), id_col, text_col).join(F.broadcast(ids), "i").select("y", "t")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))
    # a text without words stands for itself
    grams = F.when(F.size("w") == 0, F.array(F.xxhash64("t"))).otherwise(grams)
    rows = rows.withColumn("w", F.regexp_extract_all(F.lower("t"), F.lit(WORD.pattern), 0)).withColumn("g", grams)

    def sketch(salt: int) -> Column:
        return F.array_min(F.transform("g", lambda x: F.xxhash64(x, F.lit(salt))))

    for salt in (1, 2):
        rows = rows.withColumn("m", sketch(salt)).dropDuplicates(["y", "m"])
    return rows.select("y", "t")


def thin(terms: dict[str, tuple[int, float]], same: float = 0.9) -> dict[str, float]:
    """Of a beginning and its continuations keep the longest that most of the texts share, else the beginning alone."""
    under: dict[str, list[str]] = {}
    for t in terms:
        for n in PREFIXES:
            if len(t.rstrip("*")) >= n and t[:n] + "*" != t:
                under.setdefault(t[:n] + "*", []).append(t)
    known = {t for t in terms if not any(terms[o][0] >= same * terms[t][0] for o in under.get(t, ()))}
    return {t: terms[t][1] for t in known if not any(t[:n] + "*" in known and t[:n] + "*" != t for n in PREFIXES if len(t.rstrip("*")) >= n)}


def learn_lexicon(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BOUND, least_share: float = 0.01, least_docs: int = 5, least_odds: float = 3.0) -> Lexicon:
    sample = materialize(labelled(df, labels, learn, id_col, text_col, label_col, bound), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x, times in terms_of(t).items():
                    n[y, x, 1] += 1
                    if times > 1:
                        n[y, x, 2] += 1
                n[y, "", 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array([k[2] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["y", "x", "k", "n"])

    # the curve is fitted to texts that the lexicon hasn't seen
    unseen = F.pmod(F.xxhash64("t"), F.lit(3)) == 0
    n = sample.filter(~unseen).mapInArrow(count, "y int, x string, k int, n bigint").groupBy("x", "k").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    n = materialize(n, "terms")
    top = n.filter(F.col("x") == "").first()
    pos, neg = (top.a, top.b) if top else (0, 0)
    odds = F.log((F.col("a") + 0.5) / (pos + 1.0)) - F.log((F.col("b") + 2.0) / (neg + 2.0))
    found = n.filter((F.col("x") != "") & (F.col("a") >= max(least_docs, least_share * pos))).withColumn("o", odds).filter(F.col("o") >= least_odds)
    rows = sorted(found.collect(), key=lambda r: (r.x, r.k))
    # once is enough where it tells as much
    once = {r.x: (r.a, float(r.o)) for r in rows if r.k == 1}
    again = {r.x: (r.a, float(r.o)) for r in rows if r.k == 2 and r.x not in once}
    kept = thin(once | again)
    lex = Lexicon(kept, twice=frozenset(kept.keys() & again.keys()))
    shared = df.sparkSession.sparkContext.broadcast(lex)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([shared.value.evidence(t) for t in batch.column(1).to_pylist()]).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array(x[:, k]) for k in range(1, 4))], names=["y", "a", "b", "c"])

    got = map_text(sample.filter(unseen), weigh, "y int, a double, b double, c double").toPandas()
    if got["y"].nunique() == 2:
        lex.curve = fit_curve(got[["a", "b", "c"]].to_numpy(), got["y"].to_numpy().astype(float))
    release(sample, n)
    return lex


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.002) -> np.ndarray:
    """Logistic regression by Newton steps, weights of the evidence not negative."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1]) + 1e-6 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, g)
        w[1:] = np.maximum(0, w[1:])
    return w


def score_toxicity(df: DataFrame, lex: Lexicon, text_col: str = "text", carry: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """``carry`` (default: doc_id) with score and predicted."""
    carry = ["doc_id"] if carry is None else carry
    src = row_and_text(df, carry, text_col)
    schema = T.StructType([src.schema["__row"], T.StructField("score", T.DoubleType())])
    known = df.sparkSession.sparkContext.broadcast(lex)  # terms of a sample of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = known.value.automaton()
        for batch in batches:
            s = [known.value.score(t.as_py(), auto) for t in texts_of(batch, carry, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["__row", "score"])

    out = src.mapInArrow(run, schema)
    return out.select(*carried("__row", carry, ("score", "predicted")), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
