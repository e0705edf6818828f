"""English stems by the published Porter2 rules, and a word class from the endings on the way.

Regions: R1 begins after the first consonant that follows a vowel, R2 likewise within
R1. In each step the longest suffix of its list that the word has decides, whether or
not its condition then holds. A ``y`` at the start or after a vowel counts as a
consonant and is written Y within the steps.
"""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
REGION = re.compile("[aeiouy][^aeiouy]")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: What may stand before a final li.
LI_ENDING = "cdeghkmnrt"
# fixed values of the published algorithm, the longest suffix first and by letters within a length
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
R1_PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
#: Beginnings that negate or strengthen.
PREFIXES = ("under", "over", "anti", "non", "dis", "irr", "unn")


def regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in R1_PREFIXES if w.startswith(p)), None)
    if r1 is None:
        m = REGION.search(w)
        r1 = m.end() if m else len(w)
    m = REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


def short_syllable(w: str) -> bool:
    """Ends in a consonant, a vowel and a consonant that isn't w, x or Y; or is a vowel and a consonant."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def consonant_ys(w: str) -> str:
    out = ""
    for k, c in enumerate(w):
        out += "Y" if c == "y" and (k == 0 or out[-1] in VOWELS) else c
    return out


def plural(w: str) -> tuple[str, str | None]:
    if w.endswith("sses"):
        return w[:-2], "plural"
    if w.endswith(("ied", "ies")):
        return (w[:-2] if len(w) > 4 else w[:-1]), "plural" if w.endswith("s") else "past"
    if w.endswith(("us", "ss")) or not w.endswith("s") or not has_vowel(w[:-2]):
        return w, None
    return w[:-1], "plural"


def participle(w: str, r1: int) -> tuple[str, str | None]:
    for s in ("eedly", "eed"):
        if w.endswith(s):
            return (w[: -len(s)] + "ee", "past") if len(w) - len(s) >= r1 else (w, None)
    for s in ("ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            cut = w[: -len(s)]
            if not has_vowel(cut):
                return w, None
            kind = "past" if s.startswith("ed") else "participle"
            if cut.endswith(("at", "bl", "iz")):
                return cut + "e", kind
            if cut.endswith(DOUBLE):
                return cut[:-1], kind
            return (cut + "e" if len(cut) <= r1 and short_syllable(cut) else cut), kind
    return w, None


def step2(w: str, r1: int) -> tuple[str, str | None]:
    for old, new in STEP2:
        if w.endswith(old):
            cut = w[: -len(old)]
            ok = len(cut) >= r1 and (old != "ogi" or cut.endswith("l")) and (old != "li" or cut[-1:] in tuple(LI_ENDING))
            return (cut + new, "adverb" if old.endswith("li") else None) if ok else (w, None)
    return w, None


def step3(w: str, r1: int, r2: int) -> tuple[str, str | None]:
    for old, new in STEP3:
        if w.endswith(old):
            cut = w[: -len(old)]
            if len(cut) < (r2 if old == "ative" else r1):
                return w, None
            return cut + new, {"ful": "adjective", "ness": "noun", "ative": "adjective"}.get(old)
    return w, None


def step4(w: str, r2: int) -> tuple[str, str | None]:
    for old in STEP4:
        if w.endswith(old):
            cut = w[: -len(old)]
            if len(cut) < r2 or (old == "ion" and not cut.endswith(("s", "t"))):
                return w, None
            return cut, "adjective" if old in ("able", "ible", "ive", "ous", "al", "ic") else "noun" if old in ("ion", "ment", "ism", "ance", "ence") else None
    return w, None


def step5(w: str, r1: int, r2: int) -> str:
    if w.endswith("e"):
        cut = w[:-1]
        return cut if len(cut) >= r2 or (len(cut) >= r1 and not short_syllable(cut)) else w
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= r2 else w


@lru_cache(1 << 16)
def stem(word: str) -> tuple[str, str]:
    """The stem, and the last word class that a step suggested (``other`` without)."""
    w = word.lower().strip("'")
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w.removesuffix(s)
            break
    if len(w) <= 2 or w in UNCHANGED:
        return w, "other"
    if w in WHOLE:
        return WHOLE[w], "participle" if w.endswith("ing") else "plural" if w.endswith("s") else "adverb"
    w = consonant_ys(w)
    r1, r2 = regions(w)
    w, kind = plural(w)
    if w in AFTER_PLURAL:
        return w, kind or "other"
    w, k = participle(w, r1)
    kind = k or kind
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for step in (lambda x: step2(x, r1), lambda x: step3(x, r1, r2), lambda x: step4(x, r2)):
        w, k = step(w)
        kind = k or kind
    return step5(w, r1, r2).lower(), kind or "other"


def superlative(word: str) -> str | None:
    """What is left of a superlative: happiest -> happy, biggest -> big, latest -> late."""
    w = word.lower()
    if not w.endswith("est") or len(w) < 6:
        return None
    cut = w[:-3]
    if cut.endswith("i"):
        return cut[:-1] + "y"
    if cut.endswith(DOUBLE):
        return cut[:-1]
    return cut + "e" if short_syllable(cut) and len(cut) <= 4 else cut if has_vowel(cut) else None


def without_prefix(word: str) -> tuple[str, bool]:
    """The word without a negating or strengthening beginning, where five letters stay, and whether it had one."""
    for p in PREFIXES:
        if word.startswith(p) and len(word) - len(p) >= 5:
            keep = 1 if p in ("irr", "unn") else 0
            return word[len(p) - keep :], True
    return word, False


#: Priority of word classes, and their numbers.
CLASSES = ("participle", "past", "plural", "adverb", "adjective", "noun", "negated", "superlative", "other")


def class_number(word: str) -> int:
    """The first class in order of priority that the word shows, as a number of four bits."""
    if superlative(word):
        return CLASSES.index("superlative")
    base, negated = without_prefix(word)
    kind = stem(base)[1]
    return CLASSES.index("negated" if negated and kind == "other" else kind)
