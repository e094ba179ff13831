"""The Porter stemmer, after the published algorithm (Porter 1980). For a distinct vocabulary, not for running text."""

from __future__ import annotations

import re

# The suffix rules of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words with other signs stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in ((STEP2, 0), (STEP3, 0)):
        for suffix in sorted(rules, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > least:
                    w = w[: -len(suffix)] + rules[suffix]
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
