"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans, leftmost and non-overlapping per kind. Every
search runs in time linear in the text: an attempt never starts inside a run that an
earlier attempt has read.

The field adds spans that the patterns can't see: obfuscated addresses, local phone
numbers, account and social security numbers, keys and passwords. Tokens are words
and single marks; features are the word shape (runs of A, a and 9 shortened), its
length class, the shapes of the neighbours and the cue words around. It is trained on
the exact likelihood over the small labelled table below, each row filled ``COPIES``
times with values from a seeded generator, and decoded by Viterbi in numpy over
batches of segments of like length. A segment is a run of tokens around those with a
digit, an ``@``, a word of ``STRONG`` or part of a cue (a name with ``at`` between
brackets or before a dotted name; ``key`` before ``=`` or ``:``): with none of these
within ``REACH`` tokens, the label is O. Segments end with the line; one of more than
``LONGEST`` tokens is decoded in parts, so memory stays bounded on lines of any length.

Defined results: a null or empty text has no spans; spans are code point offsets with
the end exclusive; a field span that overlaps a base span (of any kind) is dropped, so
base spans stay; of the field's own spans none overlap, so there are no ties; whole
texts are read, however long; repeated rows get a row each; an empty table gives an
empty result; a carried column that has the name of a result is renamed (see
``carried``), other extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import batch_sizes, carried, slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# what comes before a digit run tells whether the search has been there already
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text)}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    card = []
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            card.append(m.span())
    out["card"] = card
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# the labelled table: marked spans are <<kind|text>>; {names} are filled with values that a seeded generator makes
TABLE = (
    "write to <<email|{who} dot {who} at {host} dot com>> for the files",
    "contact <<email|{who} at mail dot {host} dot org>> or come by",
    "reach me: <<email|{who}(at){host}.example.net>> any day",
    "{word} <<email|{who}(at){host}.example.com>> {word}",
    "send it to <<email|{who}.k[at]{host}.com>> before noon",
    "{word} <<email|{who}[at]{host}.{host}.org>>, {word} {word}",
    "mail <<email|{who} (at) {host}.com>> {word}",
    "{word} <<email|{who} [at] {host} [dot] com>> {word}",
    "{word} <<email|{who} (at) {host} (dot) org>>. {word}",
    "schreib an <<email|{who} punkt k at post punkt {host} punkt de>> bitte",
    "{word}: <<email|{who} (at) {host} (punkt) de>> {word}",
    "{word} <<email|{who} arobase {host} point fr>> {word}",
    "escribe a <<email|{who} arroba {host} punto es>> hoy",
    "we met at noon at the dot on the map",
    "look at the dot com boom of {year} and at the end",
    "{word} at {host}.com we read {word} point {word}",
    "he was at {word} {word} at {num} (at last) {word}",
    "call <<phone|({n3}) {n3}-{n4}>> after six",
    "tel <<phone|030 {n7}>> is the office",
    "phone: <<phone|{n3}-{n3}-{n4}>> ask for Tom",
    "Tel.: <<phone|089/{n6}-{n2}>> von 9 bis 17 Uhr",
    "call me on <<phone|0171 {n7}>> tonight",
    "dial <<phone|({n3}) {n3} {n4}>> now",
    "phone number <<phone|0049 30 {n7}>> is new",
    "téléphone <<phone|06 {n2} {n2} {n2} {n2}>> {word}",
    "appelez le <<phone|01 {n2} {n2} {n2} {n2}>> ce soir",
    "teléfono: <<phone|91 {n3} {n2} {n2}>> {word}",
    "llame al <<phone|6{n2} {n3} {n3}>> hoy",
    "Telefon <<phone|0{n3}/{n7}>> {word}",
    "Handy: <<phone|017{n1} {n7}>> {word}",
    "{word} {word} +1 ({n3}) {n3}-{n4} {word} {word}",
    "it was {year} and {year} when {num} people came",
    "pages {n3}-{n3} of volume {n1} in {year}",
    "the price is 1,{n3}.00 or 1.{n3} for {n2} pieces",
    "version {n1}.{n1}.{n1} came after {n1}.{n1}.{n1} in {year}",
    "{word} License, Version 2.0. {word} {word}",
    "from 10:{n2} to 12:{n2} on 12/05/{year} there were {n3} seats",
    "chapter {n1} section {n2} line {n5}",
    "{word} {n3}.{n2}.{n3}.{n2} {word} {n3}.{n3}.{n2}.{n1} {word}",
    "{word} {word} {n8}{n8} {word} {word}",
    "{word} {n16} {word} {n16}",
    "order {n5} shipped on {year}-03-{n2} with {n1} items",
    "{year}-{n2}-{n2}T{n2}:{n2}:{n2}Z {word} {n2}",
    "room {n2} floor {n1} building {n2} has {n1} doors",
    "in {year} there were {n2} of {n3} left",
    "see fig. {n2} and table {n1} for {n2} percent",
    "commit {hex7} by {who} fixed line {n3}",
    "id {n8} {word} no. {n6} {word} nr {n4}",
    "color #{hex6} and width = {n3}, height: {n3}",
    "x = {n2} and y = \"{word}\" with n: {n1}",
    "{word}@{n1}.{n2} {word} @{word}{n2}",
    "{secret_name} = \"<<secret|{key}>>\" {word}",
    "{word} {secret_name} = \"<<secret|{key}>>\" {word} {word}",
    "{word}. {secret_name} = \"<<secret|{hex40}>>\"!! {word}",
    "{word}, {secret_name} = \"<<secret|{hex40}>>\"### {word}",
    "{secret_name}=\"<<secret|{key}>>\"",
    "{secret_name}=<<secret|{key}>> {word}",
    "{word} {secret_name}: <<secret|{key}>> {word}",
    "{secret_name}: '<<secret|{key}>>', {word}",
    "{word} = '{word}'; {secret_name} = '<<secret|{hex40}>>'; {word}",
    "\"{secret_name}\": \"<<secret|{key}>>\", \"{word}\": {n2}",
    "{word} {secret_name} = <<secret|{hex40}>> {word}",
    "| {word} | {secret_name} = \"<<secret|{hex40}>>\" | {word} |",
    "export {secret_name}=<<secret|{key}>>",
    "{secret_name} <<secret|{key}>> was leaked",
    "password=<<secret|{hex13}>> in the log",
    "password: <<secret|{mixed}>> was leaked",
    "Passwort: <<secret|{mixed}>> bitte {word}",
    "mot de passe : <<secret|{mixed}>> {word}",
    "contraseña = \"<<secret|{mixed}>>\" {word}",
    "token=<<secret|{hex16}>> was found",
    "Authorization: Bearer <<secret|{key}>> {word}",
    "key <<secret|AKIA{upper16}>> is public",
    "{word} <<secret|AKIA{upper16}>> {word}",
    "the password was lost and the token is gone",
    "a key of {n2} letters and a token of {n1}",
    "{word} token = {n1} {word} key = {n2}",
    "the secret of {word} and the password of {num} {word}",
    "key: {word}, token: {word}, secret: {word}",
    "iban <<account|DE{n2}{n18}>> for the rent",
    "account <<account|GB{n2}NWBK{n14}>> is closed",
    "IBAN: <<account|FR{n2}{n10}{n7}M02{n3}>> merci",
    "{word} IBAN <<account|ES{n2}{n20}>> {word}",
    "Konto <<account|AT{n2}{n16}>> {word}",
    "{word} <<account|DE{n2} {n4} {n4} {n4} {n4} {n2}>> {word}",
    "ssn <<ssn|{n3}-{n2}-{n4}>> on file",
    "social security number <<ssn|{n3}-{n2}-{n4}>> was printed",
    "{word} SSN: <<ssn|{n3}-{n2}-{n4}>>, {word}",
    "a b c d e f g",
    "{word} {word} {word}. {word} {word} {word}",
    "| {word} | {n2} | {word} | {n3} |",
    "il y a {n2} ans et {n1} mois",
    "hay {n2} casas y {n2} calles",
    "es gibt {n2} Tage und {n2} Monate",
)
#: Rows that are made of each row of the table.
COPIES = 3
SECRET_NAMES = ("token", "TOKEN", "Token", "password", "secret", "api_key", "access_token", "auth_token", "client_secret", "API_KEY", "secret_key", "apikey", "passwd", "pwd", "passwort", "clave", "jeton")
SYLLABLES = ("an", "ber", "co", "dle", "er", "fil", "go", "hin", "ist", "ka", "lor", "men", "nou", "or", "pre", "qui", "ro", "sten", "tu", "ver", "wo", "ya", "zen", "äch", "éta", "ñar")


def filled(row: str, rng: random.Random) -> str:
    """A row of the table with made values."""

    def pick(chars: str, n: int) -> str:
        return "".join(rng.choice(chars) for _ in range(n))

    def keylike(chars: str, n: int) -> str:
        return pick(chars, n - 2) + rng.choice("abcdef" if chars != UPPER else "ABCDEF") + rng.choice(DIGITS)

    def value(m: re.Match) -> str:
        name = m.group(1)
        if name in ("word", "who", "host"):
            w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
            return w if name != "word" or rng.random() < 0.8 else w.title() if rng.random() < 0.5 else w.upper()
        if name == "year":
            return str(rng.randint(1800, 2040))
        if name == "num":
            return str(rng.randint(0, 5000))
        if name == "secret_name":
            return rng.choice(SECRET_NAMES)
        if name == "mixed":
            return rng.choice(UPPER) + keylike(LOWER + DIGITS, rng.randint(7, 14))
        if name == "key":
            return keylike(rng.choice((HEX, HEX.upper(), LOWER + UPPER + DIGITS, LOWER + DIGITS)), rng.choice((16, 20, 24, 32, 40, 48, 64)))
        kind, n = re.match(r"(n|hex|upper)(\d+)", name).groups()
        return pick(DIGITS, int(n)) if kind == "n" else keylike(HEX, int(n)) if kind == "hex" else keylike(UPPER + DIGITS, int(n))

    return re.sub(r"\{(\w+)\}", value, row)


DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
UPPER = LOWER.upper()


def labelled_rows(seed: int = 1, copies: int = COPIES) -> list[str]:
    rng = random.Random(seed)
    return [filled(row, rng) for _ in range(copies) for row in TABLE]


#: Words that tell what stands near them.
CUE_WORDS = frozenset(("at", "dot", "punkt", "point", "punto", "arobase", "arroba", "password", "passwd", "pwd", "passwort", "kennwort", "passe", "contraseña", "clave", "jeton", "token", "secret", "key", "apikey", "bearer", "call", "dial", "tel", "phone", "telefon", "téléphone", "teléfono", "handy", "appelez", "llame", "iban", "account", "konto", "ssn", "security", "number", "commit", "version", "order", "id"))
STRONG = frozenset(("dot", "punkt", "arobase", "arroba", "password", "passwd", "pwd", "passwort", "kennwort", "contraseña", "clave", "jeton", "token", "secret", "apikey", "bearer"))
# places that open a segment without a hot word: ``at`` between brackets or before a dotted name, ``key`` before a value
CUE = r"[(\[{<][^\S\n]{0,4}at[^\S\n]{0,4}[)\]}>](?:[^\S\n]{0,4}[\w-]++(?:\.[\w-]++)*+)?|\bat[^\S\n]{1,4}[\w-]++(?:\.[\w-]++)++|(?<![^\W_])key[\"']?[^\S\n]{0,4}[=:]"
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
REACH = 4
BUCKETS = 1 << 15
#: Features of a token; bucket BUCKETS stands for none.
FEATURES = 22
#: Tokens of the longest segment; a longer one is cut.
LONGEST = 4096


@lru_cache(1 << 16)
def shape(word: str) -> str:
    if len(word) >= 8 and not word.isalpha() and not word.isdigit():
        return "M" + ("A" if word.isupper() else "a")  # letters among digits, as in keys
    s = re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"\d", "9", word)))
    return re.sub(r"(9{4})9+", r"\1+", s)


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def token_features(words: list[str]) -> np.ndarray:
    """Hashed features of each token, tokens x FEATURES."""
    shapes = [shape(w) for w in words]
    lows = [w.lower() if len(w) <= 16 else "" for w in words]
    names = [x if x in CUE_WORDS or len(x) == 1 else "" for x in lows]
    n = len(words)
    out = np.full((n, FEATURES), BUCKETS, np.int64)
    for k, w in enumerate(words):
        s = shapes[k]
        near = [shapes[j] if 0 <= j < n else "$" for j in (k - 2, k - 1, k + 1, k + 2)]
        cue = [names[j] if 0 <= j < n else "" for j in (k - 2, k - 1, k + 1, k + 2)]
        mixed = not w.isalpha() and not w.isdigit() and len(w) > 1
        size = min(len(w), 40) // 4 if len(w) > 3 else -len(w)
        # the last cue word within five tokens, and the first one that follows
        back = next((names[j] for j in range(k - 1, max(-1, k - 6), -1) if len(names[j]) > 1), "")
        ahead = next((names[j] for j in range(k + 1, min(n, k + 4)) if len(names[j]) > 1), "")
        feats = [f"s{s}", f"n{size}/{mixed}", f"l{near[1]}/{s}", f"r{s}/{near[2]}", f"ll{near[0]}", f"rr{near[3]}", f"b{back}/{s}", f"a{ahead}/{s}", f"b{back}/{mixed}/{size}", f"k{cue[0]}{cue[1]}/{mixed}", f"m{back}{cue[1]}/{s}", f"j{cue[1]}/{cue[2]}/{s}"]
        feats += [f"c{j}{c}" for j, c in enumerate(cue) if c]
        if names[k]:
            feats += [f"w{names[k]}", f"w{names[k]}/{near[1]}/{near[2]}"]
        else:
            feats.append(f"e{lows[k][:2] if w.isalpha() else ''}{len(w) < 4}")
        out[k, : len(feats)] = [bucket(f) for f in feats]
    return out


def parse(row: str) -> tuple[list[str], list[str]]:
    """Tokens and BIO labels of a row of the table."""
    words, labels = [], []
    at = 0
    for m in re.finditer(r"<<(\w+)\|(.*?)>>", row):
        for text, kind in ((row[at : m.start()], None), (m.group(2), m.group(1))):
            own = TOKEN.findall(text)
            words += own
            labels += [("B-" if k == 0 else "I-") + kind if kind else "O" for k in range(len(own))]
        at = m.end()
    own = TOKEN.findall(row[at:])
    return words + own, labels + ["O"] * len(own)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # buckets and the empty one x labels
    trans: np.ndarray  # from x to
    start: np.ndarray

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[feats].sum(1)

    def viterbi(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of several segments at once, padded to the longest."""
        n, longest, k = len(batch), max(map(len, batch)), len(self.labels)
        size = np.array(list(map(len, batch)))
        e = np.zeros((n, longest, k))
        for i, x in enumerate(batch):
            e[i, : len(x)] = x
        score = self.start + e[:, 0]
        back = np.zeros((n, longest, k), np.int16)
        for t in range(1, longest):
            step = score[:, :, None] + self.trans
            best = step.argmax(1)
            live = (size > t)[:, None]
            back[:, t] = np.where(live, best, np.arange(k))
            score = np.where(live, np.take_along_axis(step, best[:, None], 1)[:, 0] + e[:, t], score)
        path = np.zeros((n, longest), np.int16)
        path[:, -1] = score.argmax(1)
        for t in range(longest - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return [path[i, :m] for i, m in enumerate(size)]


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@lru_cache(2)
def train_crf(seed: int = 1, steps: int = 60, rate: float = 0.25, decay: float = 2e-3) -> Crf:
    """Adagrad on the log likelihood of all rows together, gradients by forward-backward over padded rows."""
    rows = [parse(r) for r in labelled_rows(seed)]
    labels = ["O", *sorted({x for _, own in rows for x in own} - {"O"})]
    number = {x: k for k, x in enumerate(labels)}
    n, m, longest = len(labels), len(rows), max(len(w) for w, _ in rows)
    trans, start = np.zeros((n, n)), np.zeros(n)
    for a in labels:
        for b in labels:
            if b.startswith("I-") and a[2:] != b[2:]:
                trans[number[a], number[b]] = -20.0
        if a.startswith("I-"):
            start[number[a]] = -20.0
    size = np.array([len(w) for w, _ in rows])
    live = np.arange(longest) < size[:, None]
    feats = np.full((m, longest, FEATURES), BUCKETS, np.int64)
    y = np.zeros((m, longest), np.int64)
    for i, (w, own) in enumerate(rows):
        feats[i, : len(w)] = token_features(w)
        y[i, : len(w)] = [number[x] for x in own]
    # tokens of each feature, sorted by feature
    flat = feats[live]
    token = np.repeat(np.arange(len(flat)), FEATURES)
    order = np.argsort(flat.ravel(), kind="stable")
    known, first = np.unique(flat.ravel()[order], return_index=True)
    token = token[order]
    used = known < BUCKETS
    gold = np.zeros((m, longest, n))
    gold[np.arange(m)[:, None], np.arange(longest), y] = live
    both = (live[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1))
    weights = np.zeros((BUCKETS + 1, n))
    sq_w, sq_t = np.full((BUCKETS + 1, n), 1e-3), np.full((n, n), 1e-3)
    for _ in range(steps):
        e = weights[feats].sum(2)
        fwd, bwd = np.zeros((m, longest, n)), np.zeros((m, longest, n))
        fwd[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(live[:, t, None], logsumexp(fwd[:, t - 1, :, None] + trans, 1) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], logsumexp(trans + (e[:, t + 1] + bwd[:, t + 1])[:, None], 2), 0.0)
        z = logsumexp(fwd[:, -1], 1)
        g = (np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None] - gold)[live]
        pair = np.zeros((n, n))
        for t in range(1, longest):
            p = np.exp(fwd[:, t - 1, :, None] + trans + (e[:, t] + bwd[:, t])[:, None] - z[:, None, None])
            pair += (p * live[:, t, None, None]).sum(0)
        g_w = np.add.reduceat(g[token], first, axis=0)[used] + decay * weights[known[used]]
        g_t = pair - both
        sq_w[known[used]] += g_w * g_w
        weights[known[used]] -= rate * g_w / np.sqrt(sq_w[known[used]])
        sq_t += g_t * g_t
        trans = trans - rate * g_t / np.sqrt(sq_t)
    return Crf(labels, weights, trans, start)


def cues(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Places of CUE, and with an ``at`` the name before it; a place never reaches into the one before."""
    for m in CUES.finditer(text, start, end):
        a = m.start()
        if text[a] not in "kK":
            while a > start and m.start() - a < 4 and text[a - 1].isspace():
                a -= 1
            while a > start and (text[a - 1] in LOCAL or text[a - 1].isalnum()):
                a -= 1
        yield a, m.end()
        start = m.end()


def hot_tokens(text: str, start: int, end: int) -> Iterator[tuple[re.Match, bool]]:
    """Tokens of a line, and whether each may be part of personal data."""
    places = cues(text, start, end)
    now = next(places, None)
    for m in TOKEN.finditer(text, start, end):
        while now and now[1] <= m.start():
            now = next(places, None)
        w = m.group()
        yield m, bool(now and now[0] <= m.start()) or w == "@" or HAS_DIGIT.search(w) is not None or w.lower() in STRONG


def segments(text: str) -> Iterator[list[re.Match]]:
    """Runs of tokens within REACH of a hot one. Only the open run is held, LONGEST tokens at most."""
    for line in LINE.finditer(text):
        if not TRIGGER.search(text, line.start(), line.end()):
            continue
        seg: list[re.Match] = []
        before: deque[re.Match] = deque(maxlen=REACH)
        gap = -1  # tokens since the last hot one; -1 outside of a run
        for m, hot in hot_tokens(text, line.start(), line.end()):
            if hot:
                seg = [*before] if gap < 0 else seg
                seg.append(m)
                gap = 0
            elif gap < 0:
                before.append(m)
                continue
            else:
                seg.append(m)
                gap += 1
            if gap == 2 * REACH:
                yield seg[:-REACH]
                before, gap = deque(seg[-REACH:], REACH), -1
            elif len(seg) >= LONGEST:
                yield seg
                seg, before, gap = [], deque(maxlen=REACH), -1
        if gap >= 0:
            yield seg[: len(seg) - max(0, gap - REACH)]


LINE = re.compile(r"[^\n]+")
HAS_DIGIT = re.compile(r"\d")
CUES = re.compile(CUE, re.I)
TRIGGER = re.compile(rf"[\d@]|(?<![^\W_])(?:{'|'.join(sorted(STRONG))})(?![^\W_])|{CUE}", re.I)
#: Tokens of one Viterbi batch.
BATCH = 20_000


def field_spans(texts: list[str], crf: Crf) -> list[list[tuple[str, int, int]]]:
    """Spans of the field in each text, by place. Segments of like length are decoded together as soon as they fill a batch."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo: dict[int, list[tuple[int, list[re.Match]]]] = {}
    for k, t in enumerate(texts):
        for seg in segments(t):
            held = todo.setdefault(len(seg).bit_length(), [])
            held.append((k, seg))
            if len(held) << len(seg).bit_length() >= BATCH:
                decode(held, crf, out)
                held.clear()
    for held in todo.values():
        if held:
            decode(held, crf, out)
    return [sorted(x, key=lambda s: s[1]) for x in out]


def decode(part: list[tuple[int, list[re.Match]]], crf: Crf, out: list[list[tuple[str, int, int]]]) -> None:
    for (k, seg), path in zip(part, crf.viterbi([crf.emissions(token_features([m.group() for m in s])) for _, s in part]), strict=True):
        if not path.any():
            continue
        names = [crf.labels[x] for x in path]
        j = 0
        while j < len(names):
            if names[j].startswith("B-"):
                i = j
                while j + 1 < len(names) and names[j + 1] == "I-" + names[i][2:]:
                    j += 1
                out[k].append((names[i][2:], seg[i].start(), seg[j].end()))
            j += 1


def apart(more: list[tuple[str, int, int]], own: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``more`` that overlap none of ``own``; both are walked once in order of place."""
    out, k, reach = [], 0, 0
    own = sorted(own, key=lambda s: s[1])
    for kind, a, b in more:
        while k < len(own) and own[k][1] < b:
            reach = max(reach, own[k][2])
            k += 1
        if reach <= a:
            out.append((kind, a, b))
    return out


def find_pii(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: doc_id) with ``base`` and ``added``: arrays of (kind, start, end)."""
    carry = ["doc_id"] if carry is None else carry
    crf = df.sparkSession.sparkContext.broadcast(train_crf())
    src = df.select(F.struct(*[F.col(c) for c in carry]).alias("__row"), F.col(text_col).alias("__text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([src.schema["__row"], T.StructField("base", span), T.StructField("added", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch_sizes(batch), 8 << 20):
                yield one(batch.slice(i, j - i))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        base, added = [], []
        for t, more in zip(texts, field_spans(texts, crf.value), strict=True):
            own = [(k, a, b) for k, spans in (base_spans(t).items() if ANY.search(t) else ()) for a, b in spans]
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            added.append([{"kind": k, "start": a, "end": b} for k, a, b in apart(more, own)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], names=["__row", "base", "added"])

    out = src.mapInArrow(run, schema)
    return out.select(*carried("__row", carry, ("base", "added")), "base", "added")


ANY = re.compile(r"[0-9@]")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the joined spans of ``find_pii``; kinds that only the field has follow the base kinds by name. n_spans counts all spans, n_secret the keys and passwords."""
    line = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), x.kind), F.lit(0)), F.lit(len(KINDS) + 1))
    keyed = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(rank(x).alias("r"), x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))
    joined = lambda c: F.array_join(F.transform(keyed(c), line), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        *[c for c in found.columns if c not in ("base", "added")],
        *[count(k) for k in KINDS],
        F.sha2(F.encode(joined(F.col("base")), "utf-8"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"),
        F.size(F.filter("added", lambda x: x.kind == "secret")).cast("bigint").alias("n_secret"),
    )
