"""Porter's stemmer (Program 14(3), 1980) and the folding of marks, for the full-text index."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

VOWEL = "(?:[aeiou]|(?<![aeiou])y)"
# The suffix rules of steps 2, 3 and 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
ENDS = sorted([*STEP4, "ion"], key=lambda e: -len(e))


def _longest_first(rules: list[str]) -> list[tuple[str, str]]:
    return [tuple(r.split(":")) for r in sorted(rules, key=lambda r: -len(r.split(":")[0]))]


RULES2, RULES3 = _longest_first(STEP2), _longest_first(STEP3)


def _shape(stem: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _swapped(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > least else w
    return w


def stem(word: str) -> str:
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swapped(_swapped(w, RULES2, 0), RULES3, 0)
    end = next((e for e in ENDS if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@cache
def _marks() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))


def folded(text: str) -> str:
    """Lower case, without combining marks."""
    out = text.lower()
    if not out.isascii():
        out = unicodedata.normalize("NFD", out)
        for mark in _marks().intersection(out):
            out = out.replace(mark, "")
    return out


def words(text: str | None) -> list[str]:
    """Alphanumeric runs, folded."""
    return re.findall(r"[^\W_]+", folded(text or ""))


def terms(text: str | None) -> list[str]:
    """Stems of the alphanumeric runs."""
    found = words(text)
    known = {w: stem(w) for w in set(found)}
    return [known[w] for w in found]
