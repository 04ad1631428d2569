"""The suffix-stripping algorithm that M. F. Porter published in 1980, for English words in lower case."""

from __future__ import annotations

import re

# The published suffix tables of steps 2 to 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """The word as runs of c and v; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        vowel = c in "aeiou" or (c == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (cut := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(word, table)) and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    if (s := _longest(word, _STEP4)) and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    if _measure(word) > 1 and _double(word) and word[-1] == "l":
        word = word[:-1]
    return word
