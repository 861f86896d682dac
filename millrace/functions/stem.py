"""Porter's stemming algorithm for English, as published in 1980."""

from __future__ import annotations

import re

# The suffixes of steps 2, 3 and 4 and what they become, in the order they are tried.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

def _shape(s: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(s):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _short(s: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


def _swap(w: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + rules[end] if _measure(stem) > 0 else w
    return w


def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and words with other than Latin letters, stay."""
    w = word
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            s = w[: -len(end)]
            if _measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w
