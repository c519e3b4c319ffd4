"""Suffix stripping after Porter (1980), with the usual later extensions, for tokens of lower-case letters and digits."""

from __future__ import annotations

# fixed values: irregular forms of the extended algorithm
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# fixed values: suffixes of the second, third and fourth step, as published
DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
SINGLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _pattern(word: str) -> str:
    """``c`` and ``v`` per letter; a ``y`` after a consonant is a vowel."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return _pattern(stem).count("vc")


def _ends_cvc(word: str) -> bool:
    p = _pattern(word)
    return (len(p) >= 3 and p[-3:] == "cvc" and word[-1] not in "wxy") or (len(p) == 2 and p == "vc")


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            return w[: len(w) - len(suffix)] + to
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: len(w) - len(suffix)]
        if w.endswith(suffix) and "v" in _pattern(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _pattern(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _ends_cvc(stem) else stem
    return w


def _longest(w: str, rules: tuple, least: int) -> str:
    for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + to if measure(stem) > least else w
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _derived(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    return _longest(w, DOUBLE, 0)


def _bare(w: str) -> str:
    for suffix in sorted(LAST, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            fits = measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
            return stem if fits else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem, m = w[:-1], measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay as they are."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if len(w) > 2 and w.endswith("y") and _pattern(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _tidy(_bare(_longest(_derived(w), SINGLE, 0)))
