"""Context keys over the characters of a text, and how well each predicts the next one.

A context is a tuple of features of the position, all known before the character is
read. Its prediction is the character that followed the same tuple the last time within
the text; without such a time, or where a feature doesn't exist yet, it is silent.
Features are built once for each text as arrays of numbers, contexts combine them.

Defined results: a null or empty text has no positions; rows that are alike count each;
a context that never predicts has no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.matching import gram_ids, previous
from corpusloom.operators.symbols import code_points
from corpusloom.plans.registry import query
from corpusloom.sources.tables import dealt, table

#: Coarse and finer classes of characters, in the order of the tests.
TWO_BITS = (("l", r"[a-z]"), ("u", r"[A-Z]"), ("d", r"[0-9]"))
THREE_BITS = (*TWO_BITS, ("b", r"[ \t]"), ("n", r"[\n\r]"), ("s", r"[.!?,;:]"), ("q", r"[(){}<>'\x22]|\[|\]"))
FOUR_BITS = (*THREE_BITS[:5], ("e", r"[.!?]"), ("c", r"[,;:]"), ("o", r"[({<]|\["), ("k", r"[)}>]|\]"), ("q", r"['\x22]"), ("m", r"[-+*/=%&#@|~^$_\\\x60]"))
#: Small closed word classes.
TYPES = {"article": ("the", "a", "an"), "conjunction": ("and", "or", "but", "if", "than"), "preposition": ("of", "in", "to", "for", "on", "with", "at", "by", "from"), "pronoun": ("he", "she", "it", "they", "we", "you", "i"), "verb": ("is", "was", "be", "are", "were", "has", "have", "had")}
TYPE_OF = {w: t for t, ws in TYPES.items() for w in ws}
SKIPPED = frozenset((*TYPES["article"], *TYPES["conjunction"]))
ORDERS = (1, 2, 3, 4, 5, 6, 8, 13)

#: Contexts by name: the features that make the key.
CONTEXTS: dict[str, tuple[str, ...]] = {
    **{f"order{k}": (f"o{k}",) for k in ORDERS},
    "order2+classes2": ("o2", "h2"),
    "order2+classes3": ("o2", "h3"),
    "masked4": ("o1", "h3", "h4"),
    "char+class3": ("o1", "h3"),
    "class_pairs": ("h4",),
    "class_runs": ("r3",),
    "class_runs+char": ("r3", "o1"),
    "class_runs+word": ("r3", "w0"),
    "word": ("w0",),
    "word+surround": ("w0", "sur"),
    "word+number": ("w0", "dr"),
    "word+1": ("w0", "w1"),
    "word+1+2": ("w0", "w1", "w2"),
    "word+2": ("w0", "w2"),
    "word+3": ("w0", "w3"),
    "word+1+3": ("w0", "w1", "w3"),
    "word+2+3": ("w0", "w2", "w3"),
    "word3+char+classes": ("w3", "o1", "h2"),
    "word+content": ("w0", "ws"),
    "word+type": ("w0", "wt"),
    "type+char": ("wt", "o1"),
    "word+last_verb": ("w0", "lv"),
    "line_first+char": ("fc", "o1"),
    "line_first+state+classes": ("fc", "col8", "h3"),
    "line_word+word": ("fw", "w0"),
    "sentence_word+word": ("sw", "w0"),
    "line_state+char": ("lt", "o1"),
    "bitmap": ("bm",),
    "bitmap+char": ("bm", "o1"),
    "space_distance+char": ("ds", "o1"),
    "run_length+char": ("rl", "o1"),
    "codeword": ("na", "o1"),
    "number+char": ("dr", "o1"),
    "sparse_2": ("l2",),
    "sparse_1_3": ("l1", "l3"),
    "sparse_2_3": ("l2", "l3"),
    "sparse_2_3_4": ("l2", "l3", "l4"),
    "sparse_3_4": ("l3", "l4"),
    "masked_letters": ("l1", "l3", "h2"),
    "char_x_classes": ("l1", "h4"),
    "delimiter_state": ("o1", "sur"),
    "word+sentence": ("w0", "sw", "o1"),
    "content+type": ("ws", "wt", "o1"),
    "verb+word": ("lv", "w0", "w1"),
    "space_distance+word": ("ds", "w1"),
    "run_length+classes": ("rl", "h3"),
    "indirect": ("i1", "o1"),
    "indirect2": ("i2", "o1"),
    "indirect+word": ("i1", "w0"),
}
#: Contexts that need lines: the characters above, and the fields of a table.
LINE_CONTEXTS: dict[str, tuple[str, ...]] = {
    "above": ("up",),
    "above+char": ("up", "o1"),
    "above+left": ("up", "ul", "o1"),
    "column+class": ("col", "h2"),
    "line_first+column": ("fc", "col"),
    "above+word": ("up", "w0"),
}
#: Contexts of nesting.
BRACKET_CONTEXTS: dict[str, tuple[str, ...]] = {
    "bracket": ("br", "bd"),
    "bracket+char": ("br", "o1"),
    "bracket+classes": ("br", "h3"),
    "bracket+distance": ("br", "bn"),
    "bracket+class_runs": ("br", "r3"),
    "bracket+masked": ("br", "bd", "h2"),
}


def names(values: list) -> np.ndarray:
    """Numbers for values; None is -1."""
    known: dict = {}
    return np.array([-1 if v is None else known.setdefault(v, len(known)) for v in values], np.int64)


def mapped(cp: np.ndarray, rules: tuple[tuple[str, str], ...]) -> np.ndarray:
    table_ = np.full(129, len(rules), np.int64)
    for k in range(128):
        table_[k] = next((n for n, (_, rx) in enumerate(rules) if re.fullmatch(rx, chr(k))), len(rules))
    return table_[np.minimum(cp, 128)]


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    """What lies k places before; -1 where nothing does."""
    return np.concatenate([np.full(min(k, len(x)), -1, x.dtype), x[: max(0, len(x) - k)]])


def last_before(flag: np.ndarray) -> np.ndarray:
    """The last place before each one that has the flag, -1 without."""
    n = np.arange(len(flag))
    return lagged(np.maximum.accumulate(np.where(flag, n, -1)), 1)


class Features:
    """Features of all positions of a text, made when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.cp = code_points(text).astype(np.int64)
        self.n = len(self.cp)
        self.at = np.arange(self.n)
        self.made: dict[str, np.ndarray] = {}
        self.letter = ((self.cp | 32) >= 97) & ((self.cp | 32) <= 122) & (self.cp < 128)
        begin = self.letter & ~np.concatenate([[False], self.letter[:-1]])
        self.words = [w.lower() for w in re.findall("[A-Za-z]+", text)]
        # words that ended before the place
        inside = lagged(self.letter.astype(np.int64), 1) > 0
        self.ended = np.concatenate([[0], np.cumsum(begin)])[: self.n] - inside
        self.line = np.concatenate([[-1], last_before(self.cp == 10)[1:]]) if self.n else self.at
        self.word_ids = names(self.words)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            kind, digits = re.fullmatch(r"([a-z]+)(\d*)", name).groups()
            self.made[name] = getattr(self, f"f_{kind}")(*([int(digits)] if digits else []))
        return self.made[name]

    def f_o(self, k: int) -> np.ndarray:
        if self.n <= k:
            return np.full(self.n, -1, np.int64)
        return np.concatenate([np.full(k, -1, np.int64), gram_ids(self.cp, k)[:-1]])

    def history(self, cls: np.ndarray, k: int = 4) -> np.ndarray:
        out = sum(lagged(cls, j + 1) * 16**j for j in range(k))
        return np.where(self.at >= k, out, -1)

    def f_h(self, bits: int) -> np.ndarray:
        return self.history(mapped(self.cp, {2: TWO_BITS, 3: THREE_BITS, 4: FOUR_BITS}[bits]), 2 if bits == 4 else 4)

    def f_r(self, k: int) -> np.ndarray:
        cls = mapped(self.cp, THREE_BITS)
        new = np.concatenate([[True], cls[1:] != cls[:-1]]) if self.n else np.zeros(0, bool)
        runs = cls[new]
        started = np.concatenate([[0], np.cumsum(new)])[: self.n]
        key = sum(runs[np.maximum(0, started - 1 - j)] * 16**j for j in range(k)) if len(runs) else self.at
        return np.where(started >= k, key, -1)

    def f_w(self, k: int) -> np.ndarray:
        if k:
            at = self.ended - k
            return np.where(at >= 0, self.word_ids[np.maximum(at, 0)], -1) if len(self.word_ids) else np.full(self.n, -1, np.int64)
        start = last_before(~self.letter)
        low = self.text.lower() if len(self.text.lower()) == self.n else "".join(c.lower() if c.isascii() else c for c in self.text)
        return names([low[a + 1 : i] for i, a in enumerate(start.tolist())])

    def f_l(self, k: int) -> np.ndarray:
        return lagged(self.cp, k)

    def f_sur(self) -> np.ndarray:
        a = last_before(~self.letter)
        return np.where(a >= 0, self.cp[np.maximum(a, 0)], 0)

    def per_word(self, value) -> np.ndarray:  # noqa: ANN001
        """Of the words that ended before the place."""
        out = names([None, *value])
        return out[np.minimum(self.ended, len(out) - 1)]

    def running(self, keep) -> list:  # noqa: ANN001
        """After each word the last one that is kept."""
        out, last = [], None
        for w in self.words:
            last = w if keep(w) else last
            out.append(last)
        return out

    def f_ws(self) -> np.ndarray:
        return self.per_word(self.running(lambda w: w not in SKIPPED))

    def f_wt(self) -> np.ndarray:
        return self.per_word([TYPE_OF.get(w, "other") for w in self.words])

    def f_lv(self) -> np.ndarray:
        return self.per_word(self.running(lambda w: TYPE_OF.get(w) == "verb"))

    def f_fc(self) -> np.ndarray:
        first = self.line + 1
        return np.where(first < self.at, self.cp[np.minimum(first, self.n - 1)], 0)

    def f_col(self, cap: int = 1 << 40) -> np.ndarray:
        return np.minimum(cap, self.at - self.line - 1)

    def first_word(self, stop: np.ndarray) -> np.ndarray:
        """The first word since the last stop, '' until it has ended."""
        out, word, done = [], "", False
        for c, is_letter, s in zip(self.text, self.letter.tolist(), stop.tolist(), strict=True):
            out.append(word if done else "")
            if s:
                word, done = "", False
            elif not done and is_letter:
                word += c.lower()
            elif not done and word:
                done = True
        return names(out)

    def f_fw(self) -> np.ndarray:
        return self.first_word(self.cp == 10)

    def f_sw(self) -> np.ndarray:
        return self.first_word(np.isin(self.cp, (10, 33, 46, 63)))

    def f_lt(self) -> np.ndarray:
        """The class of the line's first character that isn't blank."""
        blank = np.isin(self.cp, (9, 32))
        cls = mapped(self.cp, FOUR_BITS)
        out, now = [], -1
        for c, b, k in zip(self.cp.tolist(), blank.tolist(), cls.tolist(), strict=True):
            out.append(now + 1)
            now = -1 if c == 10 else k if now < 0 and not b else now
        return np.array(out, np.int64)

    def f_bm(self) -> np.ndarray:
        x = self.letter.astype(np.int64)
        return np.where(self.at >= 8, sum(lagged(x, j + 1) << j for j in range(8)), -1)

    def f_ds(self) -> np.ndarray:
        return np.minimum(31, self.at - last_before(self.cp == 32) - 1)

    def f_rl(self) -> np.ndarray:
        new = np.concatenate([[True], self.cp[1:] != self.cp[:-1]]) if self.n else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(new, self.at, 0)) if self.n else self.at
        return np.where(self.at > 0, np.minimum(7, lagged(self.at - start + 1, 1)), -1)

    def f_dr(self) -> np.ndarray:
        return np.minimum(7, self.at - last_before(~((self.cp >= 48) & (self.cp <= 57))) - 1)

    def f_na(self) -> np.ndarray:
        start = last_before(self.cp < 128)
        return names([self.text[a + 1 : i] for i, a in enumerate(start.tolist())])

    def f_i(self, k: int) -> np.ndarray:
        """What followed the last k characters the time before."""
        if self.n <= k:
            return np.full(self.n, -1, np.int64)
        ids = gram_ids(self.cp, k)[:-1]
        prev = previous(ids)
        return np.concatenate([np.full(k, -1, np.int64), np.where(prev >= 0, self.cp[prev + k], -1)])

    def above(self, left: int) -> np.ndarray:
        before = np.where(self.line >= 0, np.concatenate([[-1], last_before(self.cp == 10)])[self.line + 1], -2) if self.n else self.at
        at = before + (self.at - self.line) - left
        ok = (self.line >= 0) & (at > before) & (at < self.line)
        return np.where(ok, self.cp[np.clip(at, 0, max(0, self.n - 1))], -1) if self.n else self.at

    def f_up(self) -> np.ndarray:
        return self.above(0)

    def f_ul(self) -> np.ndarray:
        return self.above(1)

    def nesting(self) -> tuple[np.ndarray, np.ndarray]:
        """The depth before each place, and the place of the innermost open bracket (-1 without)."""
        open_, close = np.isin(self.cp, [ord(c) for c in "<([{"]), np.isin(self.cp, [ord(c) for c in ">)]}"])
        after = np.cumsum(open_.astype(np.int64) - close)
        depth = np.concatenate([[0], after])[: self.n]
        level: dict[int, int] = {}
        out = []
        for i, (d, o) in enumerate(zip(depth.tolist(), open_.tolist(), strict=True)):
            out.append(level.get(d, -1))
            if o:
                level[d + 1] = i
        return depth, np.array(out, np.int64)

    def f_bd(self) -> np.ndarray:
        return self.nesting()[0] + (1 << 20)

    def f_br(self) -> np.ndarray:
        inner = self.nesting()[1]
        return np.where(inner >= 0, self.cp[np.maximum(inner, 0)], 0) if self.n else self.at

    def f_bn(self) -> np.ndarray:
        inner = self.nesting()[1]
        return np.where(inner >= 0, np.minimum(99, self.at - inner), 0)


def hits(f: Features, key: tuple[str, ...]) -> tuple[int, int]:
    """Predictions of a context, and those that come true."""
    ok = np.ones(f.n, bool)
    ids = np.zeros(f.n, np.int64)
    for name in key:
        x = f[name]
        ok &= x >= 0
        ids = np.unique(ids * (int(x.max(initial=0)) + 2) + x + 1, return_inverse=True)[1].astype(np.int64)
    at = np.flatnonzero(ok)
    prev = previous(ids[at])
    said = prev >= 0
    return int(said.sum()), int((f.cp[at[said]] == f.cp[at[prev[said]]]).sum())


#: Characters of texts whose features are put side by side.
POOL = 1 << 16
#: Odd multipliers of a hash.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def pooled_hits(fs: list[Features], contexts: dict[str, tuple[str, ...]], by_hash: bool = True) -> dict[str, tuple[int, int]]:
    """``hits`` of every context, summed over the texts, which are sorted together.

    Places come together by a hash of text and features. Neighbours are compared in
    full; should they differ anywhere, the context is counted text by text.
    """
    cp = np.concatenate([f.cp for f in fs])
    text = np.repeat(np.arange(len(fs)), [f.n for f in fs])
    made = {name: np.concatenate([f[name] for f in fs]) for name in {x for key in contexts.values() for x in key}}
    spare = np.uint64(len(cp).bit_length())
    low = (np.uint64(1) << spare) - np.uint64(1)
    out = {}
    for name, key in contexts.items():
        ok = made[key[0]] >= 0
        for x in key[1:]:
            ok &= made[x] >= 0
        at = np.flatnonzero(ok)
        h = text[at].astype(np.uint64) * MIX[0]
        for x in key:
            h = (h ^ made[x][at].astype(np.uint64)) * MIX[0]
            h ^= h >> np.uint64(29)
            h *= MIX[1]
        h = h ^ (h >> np.uint64(32)) if by_hash else h * np.uint64(0)
        # the place in the lowest bits: a sort of numbers keeps the order of places
        line = np.sort(h & ~low | at.astype(np.uint64))
        place = (line & low).astype(np.int64)
        same = np.flatnonzero((line[1:] ^ line[:-1]) >> spare == 0)
        a, b = place[same], place[same + 1]
        if all((x[a] == x[b]).all() for x in (text, *(made[k] for k in key))):
            out[name] = len(same), int((cp[a] == cp[b]).sum())
        else:
            each = [hits(f, key) for f in fs]
            out[name] = sum(x[0] for x in each), sum(x[1] for x in each)
    return out


def pools(texts: list[str]) -> Iterator[list[Features]]:
    own, size = [], 0
    for t in texts:
        own.append(Features(t))
        size += len(t)
        if size >= POOL:
            yield own
            own, size = [], 0
    if own:
        yield own


def context_hits(docs: DataFrame, text_col: str, contexts: dict[str, tuple[str, ...]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = {name: [0, 0] for name in contexts}
            for fs in pools(batch.column(0).to_pylist()):
                for name, got in pooled_hits(fs, contexts).items():
                    for k, x in enumerate(got):
                        total[name][k] += x
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in (0, 1))], names=["context", "n", "hit"])

    src = dealt(docs.select(text_col).filter(F.col(text_col) != ""))
    got = src.mapInArrow(run, "context string, n bigint, hit bigint")
    return got.groupBy("context").agg(F.sum("n").alias("n_predicted"), F.sum("hit").alias("n_hit")).filter("n_predicted > 0")


def case_sql(rules: tuple[tuple[str, str], ...]) -> str:
    tests = " ".join(f"WHEN regexp_full_match(c, '{rx.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, rx in rules)
    return f"CASE {tests} ELSE 'x' END"


def quoted(words: tuple[str, ...] | frozenset) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def context_sql(source: str, contexts: dict[str, tuple[str, ...]]) -> str:
    """The same features as windows over exploded characters; ``source`` gives (text)."""
    used = {x for key in contexts.values() for x in key}
    types = " ".join(f"WHEN words[e] IN ({quoted(ws)}) THEN '{t}'" for t, ws in TYPES.items())
    letter = "regexp_full_match(c, '[A-Za-z]')"
    before = "OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    column = {
        **{f"o{k}": f"CASE WHEN p > {k} THEN substr(text, p - {k}, {k}) END" for k in ORDERS},
        **{f"l{k}": f"CASE WHEN p > {k} THEN substr(text, p - {k}, 1) END" for k in range(1, 5)},
        "o1": "c1",
        "h2": "CASE WHEN p > 4 THEN substr(m2, p - 4, 4) END",
        "h3": "CASE WHEN p > 4 THEN substr(m3, p - 4, 4) END",
        "h4": "CASE WHEN p > 2 THEN substr(m4, p - 2, 2) END",
        "r3": "CASE WHEN rs >= 3 THEN substr(runs, rs - 2, 3) END",
        "w0": "lower(substr(text, nl + 1, p - 1 - nl))",
        "w1": "words[e]",
        "w2": "CASE WHEN e > 1 THEN words[e - 1] END",
        "w3": "CASE WHEN e > 2 THEN words[e - 2] END",
        "sur": "CASE WHEN nl > 0 THEN substr(text, nl, 1) ELSE '' END",
        "dr": "least(7, p - 1 - nd)",
        "ws": f"list_filter(words[1:e], lambda w: w NOT IN ({quoted(SKIPPED)}))[-1]",
        "wt": f"CASE WHEN e > 0 THEN CASE {types} ELSE 'other' END END",
        "lv": f"list_filter(words[1:e], lambda w: w IN ({quoted(TYPES['verb'])}))[-1]",
        "fc": "CASE WHEN ls + 1 < p THEN substr(text, ls + 1, 1) ELSE '' END",
        "col": "p - ls - 1",
        "col8": "least(8, p - ls - 1)",
        "fw": "lower(regexp_extract(substr(text, ls + 1, p - 1 - ls), '^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]', 1))",
        "sw": "lower(regexp_extract(substr(text, ss + 1, p - 1 - ss), '^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]', 1))",
        "lt": "substr(ltrim(substr(m4, ls + 1, p - 1 - ls), 'b'), 1, 1)",
        "bm": "CASE WHEN p > 8 THEN substr(ml, p - 8, 8) END",
        "ds": "least(31, p - 1 - sp)",
        "rl": "CASE WHEN p > 1 THEN least(7, p - cs) END",
        "na": "substr(text, na0 + 1, p - 1 - na0)",
        "i1": "f1",
        "i2": "f2",
        "up": "CASE WHEN ls > 0 AND pl + p - ls < ls THEN substr(text, pl + p - ls, 1) END",
        "ul": "CASE WHEN ls > 0 AND p - ls > 1 AND pl + p - ls - 1 < ls THEN substr(text, pl + p - ls - 1, 1) END",
        "bd": "depth",
        "br": "coalesce(oc, '')",
        "bn": "CASE WHEN io > 0 THEN least(99, p - io) ELSE 0 END",
    }
    # columns that only some features need
    last = lambda test: f"coalesce(max(CASE WHEN {test} THEN b.p END) {before}, 0)"
    count = lambda flag: f"CAST(coalesce(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) {before}, 0) AS BIGINT)"
    helpers = {
        "e": (f"{count('ws')} - CASE WHEN coalesce(lag(l) OVER o, false) THEN 1 ELSE 0 END", {"w1", "w2", "w3", "ws", "wt", "lv"}),
        "nl": (last("NOT l"), {"w0", "sur"}),
        "rs": (count("rn"), {"r3"}),
        "cs": (f"max(CASE WHEN cn THEN b.p END) {before}", {"rl"}),
        "nd": (last("c NOT BETWEEN '0' AND '9'"), {"dr"}),
        "sp": (last("c = ' '"), {"ds"}),
        "ss": (last("c IN (chr(10), '.', '!', '?')"), {"sw"}),
        "na0": (last("unicode(c) < 128"), {"na"}),
        "f1": ("CASE WHEN c1 IS NOT NULL THEN lag(c) OVER (PARTITION BY b.id, c1 ORDER BY b.p) END", {"i1"}),
        "f2": ("CASE WHEN c2 IS NOT NULL THEN lag(c) OVER (PARTITION BY b.id, c1, c2 ORDER BY b.p) END", {"i2"}),
    }
    needed = ", ".join(f"{sql if users & used else 'NULL'} AS {name}" for name, (sql, users) in helpers.items())
    pick = ", ".join(f"{column[x]} AS {x}" for x in sorted(used))
    keys = " UNION ALL ".join(f"SELECT id, p, c, '{name}' AS context, concat_ws(chr(1), {', '.join(f'CAST({x} AS VARCHAR)' for x in key)}) AS k FROM x WHERE {' AND '.join(f'{x} IS NOT NULL' for x in key)}" for name, key in contexts.items())
    mapped_sql = ", ".join(f"array_to_string(list_transform(s, lambda c: {case_sql(r)}), '') AS m{b}" for b, r in ((2, TWO_BITS), (3, THREE_BITS), (4, FOUR_BITS)))
    return f"""
WITH src AS ({source}),
t AS (SELECT row_number() OVER () AS id, text, list_filter(string_split(text, ''), lambda c: c <> '') AS s, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)) AS words FROM src WHERE text <> ''),
u AS (SELECT id, text, s, words, {mapped_sql}, array_to_string(list_transform(s, lambda c: CASE WHEN {letter} THEN '1' ELSE '0' END), '') AS ml FROM t),
ch AS (SELECT id, unnest(s) AS c, generate_subscripts(s, 1) AS p FROM u),
a AS (SELECT id, c, p, {letter} AS l, {case_sql(THREE_BITS)} AS k3, CASE WHEN c IN ('<', '(', '[', '{{') THEN 1 WHEN c IN ('>', ')', ']', '}}') THEN -1 ELSE 0 END AS d FROM ch),
b AS MATERIALIZED (SELECT *, l AND NOT coalesce(lag(l) OVER o, false) AS ws, coalesce(k3 <> lag(k3) OVER o, true) AS rn, coalesce(c <> lag(c) OVER o, true) AS cn, coalesce(sum(d) {before}, 0) AS depth,
      lag(c, 1) OVER o AS c1, lag(c, 2) OVER o AS c2, coalesce(max(CASE WHEN c = chr(10) THEN p END) {before}, 0) AS ls FROM a WINDOW o AS (PARTITION BY id ORDER BY p)),
z AS (SELECT id, string_agg(k3, '' ORDER BY p) AS runs FROM b WHERE rn GROUP BY id),
i AS (SELECT id, p, lead_depth, max(CASE WHEN opener THEN q END) OVER (PARTITION BY id, lead_depth ORDER BY p, opener ROWS UNBOUNDED PRECEDING) AS io, opener
      FROM (SELECT id, p, depth AS lead_depth, false AS opener, p AS q FROM b UNION ALL SELECT id, p, depth + 1, true, p FROM b WHERE d = 1)),
y AS MATERIALIZED (SELECT b.id, b.p, b.c, b.c1, b.depth, b.ls, {needed} FROM b WINDOW o AS (PARTITION BY b.id ORDER BY b.p)),
v AS (SELECT y.*, u.text, u.words, u.m2, u.m3, u.m4, u.ml, z.runs, coalesce(i.io, 0) AS io, coalesce(g.ls, 0) AS pl, {'q.c' if 'br' in used else 'NULL'} AS oc FROM y JOIN u USING (id) JOIN z USING (id) JOIN i ON i.id = y.id AND i.p = y.p AND NOT i.opener
      LEFT JOIN y g ON g.id = y.id AND g.p = y.ls {'LEFT JOIN y q ON q.id = y.id AND q.p = i.io' if 'br' in used else ''}),
x AS MATERIALIZED (SELECT id, p, c, {pick} FROM v),
k AS ({keys}),
h AS (SELECT context, c, lag(c) OVER (PARTITION BY id, context, k ORDER BY p) AS guess FROM k)
SELECT context, count(guess) AS n_predicted, count(*) FILTER (WHERE guess = c) AS n_hit FROM h GROUP BY context HAVING count(guess) > 0
"""


@query("context_key_hits", context_sql("SELECT text FROM conversations", CONTEXTS))
def context_key_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, class histories, words, lines, bitmaps and indirect contexts over the turns of conversations."""
    return context_hits(table(spark, sf_dir, "conversations"), "text", CONTEXTS)


@query("line_context_hits", context_sql("SELECT text FROM benchmark UNION ALL SELECT replace(replace(text, '. ', chr(10)), ', ', chr(10)) FROM conversations", LINE_CONTEXTS))
def line_context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the line before, over benchmark items and turns cut into lines at their marks."""
    turns = table(spark, sf_dir, "conversations").select(F.replace(F.replace("text", F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("\n")).alias("text"))
    return context_hits(table(spark, sf_dir, "benchmark").select("text").unionByName(turns), "text", LINE_CONTEXTS)


@query("bracket_context_hits", context_sql("SELECT html AS text FROM pages", BRACKET_CONTEXTS))
def bracket_context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the innermost open bracket, by levels of nesting, over the pages."""
    return context_hits(table(spark, sf_dir, "pages"), "html", BRACKET_CONTEXTS)
