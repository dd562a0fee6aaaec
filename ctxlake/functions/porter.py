"""Porter's stemmer (Program 14, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache



def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = dict(p.split(">") for p in "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log".split())
_STEP3 = dict(p.split(">") for p in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split())
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def _swap(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if _vowel(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _cvc(word):
                        word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(end):
            own = word[: -len(end)]
            if _measure(own) > 1 and (end != "ion" or own[-1:] in ("s", "t")):
                word = own
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word) > 1 else word
