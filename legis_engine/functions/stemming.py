"""The Porter stemmer (1980), applied to distinct terms in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The suffix lists of the published algorithm.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(w: str) -> str:
    """The word as c (consonant) and v (vowel) marks."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and len(w) >= 3 and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + new if _measure(base) > least else w
    return w


def porter(w: str) -> str:
    """Stem of a lower-case word; words of up to two letters and other scripts stay."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix):
                if "v" in _shape(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _shape(w)[-1:] == "c" and w[-1:] == w[-2:-1] and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def porter_udf(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: porter(t) if t is not None else None)
