"""A suffix stripper of the Porter family, worked out on consonant and vowel patterns."""

from __future__ import annotations

import re

#: Derivational suffixes and their replacements; the first that ends the word decides.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
#: Residual suffixes; a suffix whose stem is too short leaves the word to the next.
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or letter == "y" and out.endswith("c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word: str) -> bool:
    # A word with letters beyond ASCII counts as having one.
    return "v" in _shape(word) or not word.isascii()


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: tuple[tuple[str, str], ...]) -> str:
    rule = next((r for r in table if word.endswith(r[0])), None)
    if rule and _measure(base := word[: -len(rule[0])]) > 0:
        return base + rule[1]
    return word


def _singular(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 1 else word


def _present(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e)), "")
    base = word[: len(word) - len(ending)]
    if not ending or not _has_vowel(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
        return base[:-1]
    return base + "e" if _measure(base) == 1 and _short_end(base) else base


def _residual(word: str) -> str:
    for ending in STEP_4:
        base = word[: len(word) - len(ending)]
        if word.endswith(ending) and _measure(base) > 1 and (ending != "ion" or base[-1] in "st"):
            return base
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        m = _measure(base)
        if m > 1 or m == 1 and not _short_end(base):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem(word: str) -> str:
    word = word.lower()
    if len(word.encode()) <= 2:
        return word
    word = _present(_singular(word))
    if word.endswith("y") and len(word) > 1 and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return _final(_residual(_replaced(_replaced(word, STEP_2), STEP_3)))
