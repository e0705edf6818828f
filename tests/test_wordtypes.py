from __future__ import annotations

import pytest

from corpusloom.functions import stemmer


@pytest.mark.parametrize(("word", "kind"), [("quickly", "adverb"), ("adoption", "noun"), ("cats", "plural"), ("hoping", "participle"), ("hoped", "past"), ("hopeful", "adjective"), ("dangerous", "adjective"), ("cat", "other")])
def test_classes(word, kind):
    assert stemmer.stem(word)[1] == kind


def test_prefixes_superlatives_and_ys():
    assert [stemmer.superlative(w) for w in ("happiest", "biggest", "latest", "nearest", "test", "it")] == ["happy", "big", "late", "near", None, None]
    assert stemmer.without_prefix("irregular") == ("regular", True) and stemmer.without_prefix("unnatural") == ("natural", True) and stemmer.without_prefix("overt") == ("overt", False)
    assert stemmer.consonant_ys("yearyboyish") == "YearyboYish"
    assert stemmer.CLASSES[stemmer.class_number("happiest")] == "superlative" and stemmer.CLASSES[stemmer.class_number("dislocate")] == "negated"
    assert stemmer.regions("beautiful") == (5, 7) and stemmer.regions("beauty") == (5, 6) and stemmer.regions("communism")[0] == 6


def test_suffix_lists_have_the_longest_first():
    for own in ([s for s, _ in stemmer.STEP2], [s for s, _ in stemmer.STEP3], list(stemmer.STEP4)):
        assert own == sorted(own, key=lambda s: (-len(s), s))
