"""English suffix stripping (Porter 1980), with the usual extensions of the library that ROUGE scorers call.

The rules are tables of (suffix, replacement); of a step's rules, the first whose suffix the word has decides, whether
or not its condition then holds.
"""
from __future__ import annotations

from functools import lru_cache

# Irregular forms and suffix tables of the published algorithm and its extensions.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
             "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
          "ive", "ize"]


def shape(word: str) -> str:
    """One letter per character: v for a vowel (y after a consonant is one), c for anything else."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(stem).count("vc")


def short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = shape(word)
    return s == "vc" or (s.endswith("cvc") and word[-1] not in "wxy")


def _plural(w: str) -> str:
    if w.endswith("sses") or (w.endswith("ies") and len(w) != 4):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for suffix in ("ed", "ing"):
        stem = w[:-len(suffix)]
        if w.endswith(suffix) and "v" in shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem[-2:-1] == stem[-1] and shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and short_end(stem) else stem
    return w


def _replace(w: str, rules, least: int = 1) -> str:
    for suffix, other in rules:
        if w.endswith(suffix):
            stem = w[:len(w) - len(suffix)]
            counted = stem + "l" if suffix == "logi" else stem
            return stem + other if measure(counted) >= least else w
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]):
        return _derived(w[:-2])
    return _replace(w, STEP_2)


def _bare(w: str) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            stem = w[:len(w) - len(suffix)]
            return stem if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))) else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _tidy(_bare(_replace(_derived(w), STEP_3)))
