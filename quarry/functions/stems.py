"""English suffix stripping as a column function, by Porter's published rules (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Fixed values, the rules of the publication: suffix and what replaces it, the longer of overlapping suffixes first.
STEP_2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]

# A consonant y is written Y, so that these classes tell vowels from consonants.
_V, _C = "[aeiouy]", "[^aeiouy]"
M0 = f"^{_C}*{_V}+{_C}"  # a vowel and a consonant behind it: measure above 0
M1 = f"^{_C}*{_V}+{_C}+{_V}+{_C}"  # measure above 1
HAS_VOWEL = _V
SHORT_END = f"{_C}{_V}[^aeiouywxY]$"  # consonant, vowel, consonant other than w, x, y
DOUBLE_END = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def _head(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _first(w: Column, rules: list[tuple[str, Column]]) -> Column:
    """The result of the first rule whose suffix the word has; without any the word itself."""
    out = None
    for suffix, result in rules:
        out = F.when(F.endswith(w, F.lit(suffix)), result) if out is None else out.when(F.endswith(w, F.lit(suffix)), result)
    return out.otherwise(w)


def _where(w: Column, suffix: str, condition: str, instead: str = "") -> Column:
    head = _head(w, suffix)
    return F.when(head.rlike(condition), F.concat(head, F.lit(instead)) if instead else head).otherwise(w)


def _plural(w: Column) -> Column:
    return _first(w, [("sses", _head(w, "es")), ("ies", _head(w, "es")), ("ss", w), ("s", _head(w, "s"))])


def _past(w: Column) -> Column:
    """Step 1b: eed, ed and ing; what loses ed or ing is mended at its end."""

    def mended(x: Column) -> Column:
        more = F.when(x.rlike("(?:at|bl|iz)$") | (x.rlike(SHORT_END) & x.rlike(M0) & ~x.rlike(M1)), F.concat(x, F.lit("e")))
        return more.when(x.rlike(DOUBLE_END), _head(x, "x")).otherwise(x)

    def lost(suffix: str) -> Column:
        head = _head(w, suffix)
        return F.when(head.rlike(HAS_VOWEL), let(head, mended)).otherwise(w)

    return _first(w, [("eed", _where(w, "eed", M0, "ee")), ("ed", lost("ed")), ("ing", lost("ing"))])


def _final_y(w: Column) -> Column:
    return F.when(w.rlike("[yY]$") & _head(w, "y").rlike(HAS_VOWEL), F.concat(_head(w, "y"), F.lit("i"))).otherwise(w)


def _removed(w: Column) -> Column:
    """Step 4, where ion goes only behind s or t."""
    return _first(w, [(s, _where(w, s, f"(?:{M1[:-len(_C)]}{_C}*[st]$)" if s == "ion" else M1)) for s in STEP_4])


def _final_e(w: Column) -> Column:
    head = _head(w, "e")
    goes = head.rlike(M1) | (head.rlike(M0) & ~head.rlike(SHORT_END))
    w = F.when(F.endswith(w, F.lit("e")) & goes, head).otherwise(w)
    return let(w, lambda x: F.when(F.endswith(x, F.lit("ll")) & x.rlike(M1), _head(x, "l")).otherwise(x))


def porter(term: Column) -> Column:
    """The stem of a lower-case word; words of other than a to z, and of two letters or less, stay as they are."""
    steps = [
        lambda w: F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y"), _plural, _past, _final_y,
        lambda w: _first(w, [(s, _where(w, s, M0, r)) for s, r in STEP_2]), lambda w: _first(w, [(s, _where(w, s, M0, r)) for s, r in STEP_3]),
        _removed, _final_e, F.lower,
    ]
    out = term
    for step in steps:
        out = let(out, step)
    return F.when(term.rlike("^[a-z]{3,}$"), out).otherwise(term)


# -- the same in Python, for texts that are read there anyway ------------------------------------------------------------

_M0, _M1, _SHORT, _DOUBLE = (re.compile(p) for p in (M0, M1, SHORT_END, DOUBLE_END))
_ION, _PLAIN, _Y = re.compile(f"{M1[: -len(_C)]}{_C}*[st]$"), re.compile("[a-z]{3,}"), re.compile("([aeiouy])y")


def _stepped(w: str, rules: list[tuple[str, str]]) -> str:
    for suffix, instead in rules:
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            return head + instead if _M0.search(head) else w
    return w


def _unpast(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _M0.search(w[:-3]) else w
    x = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
    if x is None or not re.search(HAS_VOWEL, x):
        return w
    if x.endswith(("at", "bl", "iz")) or (_SHORT.search(x) and _M0.search(x) and not _M1.search(x)):
        return x + "e"
    return x[:-1] if _DOUBLE.search(x) else x


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """``porter`` of one word.  The words that came last are kept, so a text's common ones are looked up."""
    if not _PLAIN.fullmatch(word):
        return word
    w = _Y.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = _unpast(w)
    if w[-1:] in ("y", "Y") and re.search(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    w = _stepped(_stepped(w, STEP_2), STEP_3)
    for suffix in STEP_4:
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            w = head if (_ION if suffix == "ion" else _M1).search(head) else w
            break
    if w.endswith("e") and (_M1.search(w[:-1]) or (_M0.search(w[:-1]) and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    return (w[:-1] if w.endswith("ll") and _M1.search(w) else w).lower()
