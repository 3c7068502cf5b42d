"""Word stems after Porter (1980), and contiguous matches of phrases by stems."""

from __future__ import annotations

import re

#: Suffix rules of the published algorithm, (suffix, replacement), longest first within a step.
STEP_2 = (("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """A letter a character: v or c, y being a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = _swap(w, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), -1)
    if w.endswith("eed"):
        w = _swap(w, (("eed", "ee"),), 0)
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double_end(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2, 0), STEP_3, 0)
    for suffix in STEP_4:
        if w.endswith(suffix):
            left = w[: -len(suffix)]
            if _measure(left) > 1 and (suffix != "ion" or left.endswith(("s", "t"))):
                w = left
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(text: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[A-Za-z]+", text)]


def holds_phrase(text: str, phrase: str) -> bool:
    """Whether the stems of the phrase stand next to each other, in order, in the text."""
    a, b = stems(text), stems(phrase)
    return bool(b) and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
