"""Suffix stripping of English words by Porter's published algorithm, for scores that compare stems.

``extended`` are the changes that the usual ROUGE scorer's stemmer has over the paper
(a few irregular words, short words, -ied, -y after a vowel, -fulli, -logi).
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The suffixes of each step of the algorithm and what replaces them, in the order in which they are tried.
STEP_2 = "ational ate;tional tion;enci ence;anci ance;izer ize;bli ble;alli al;entli ent;eli e;ousli ous;ization ize;ation ate;ator ate;alism al;iveness ive;fulness ful;ousness ous;aliti al;iviti ive;biliti ble;fulli ful;logi log"
STEP_3 = "icate ic;ative ;alize al;iciti ic;ical ic;ful ;ness "
STEP_4 = "al;ance;ence;er;ic;able;ible;ant;ement;ment;ent;ion;ou;ism;ate;iti;ous;ive;ize"
#: Words that the extended form knows by heart.
IRREGULAR = "sky sky;skies sky;dying die;lying lie;tying tie;news news;innings inning;inning inning;outings outing;outing outing;cannings canning;canning canning;howe howe;proceed proceed;exceed exceed;succeed succeed"

_STEP_2, _STEP_3 = ([tuple(r.split(" ")) for r in rules.split(";")] for rules in (STEP_2, STEP_3))
_KNOWN = dict(r.split(" ") for r in IRREGULAR.split(";"))
_RUNS = re.compile(r"v+c+")


@lru_cache(maxsize=65_536)
def _shape(word: str) -> str:
    """A letter for each of the word's: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return len(_RUNS.findall(_shape(stem)))


def _short(stem: str, extended: bool) -> bool:
    """Whether it ends in consonant, vowel, consonant other than w, x, y."""
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or (extended and shape == "vc")


def _plural(w: str, extended: bool) -> str:
    if extended and len(w) == 4 and w.endswith("ies"):
        return w[:-1]
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            return w[: len(w) - len(suffix)] + new
    return w


def _past(w: str, extended: bool) -> str:
    if extended and w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    stem = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem, extended) else stem


def _final_y(w: str, extended: bool) -> str:
    stem = w[:-1]
    if w.endswith("y") and (len(stem) > 1 and _shape(stem)[-1] == "c" if extended else "v" in _shape(stem)):
        return stem + "i"
    return w


def _replaced(w: str, rules: list[tuple[str, str]], extended: bool) -> str:
    for suffix, new in rules:
        if not extended and suffix in ("fulli", "logi", "bli"):
            if suffix != "bli":
                continue
            suffix, new = "abli", "able"
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            # the l of -logi counts as part of the stem
            return stem + new if _measure(stem + "l" if suffix == "logi" else stem) > 0 else w
    return w


def _second(w: str, extended: bool) -> str:
    if extended and w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2], extended)
    return _replaced(w, _STEP_2, extended)


def _dropped(w: str) -> str:
    for suffix in STEP_4.split(";"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else w
    return w


def _final_e(w: str, extended: bool) -> str:
    if not w.endswith("e"):
        return w
    m = _measure(w[:-1])
    return w[:-1] if m > 1 or (m == 1 and not _short(w[:-1], extended)) else w


@lru_cache(maxsize=200_000)
def stem(word: str, extended: bool = True) -> str:
    """The stem of a word; of one or two letters, the word."""
    w = word.lower()
    if extended and w in _KNOWN:
        return _KNOWN[w]
    if len(w) < 3:
        return w
    w = _final_y(_past(_plural(w, extended), extended), extended)
    w = _dropped(_replaced(_second(w, extended), _STEP_3, extended))
    w = _final_e(w, extended)
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stems(words: list[str]) -> list[str]:
    """Stems as ROUGE takes them: words of up to three letters stay."""
    return [stem(w) if len(w) > 3 else w for w in words]
