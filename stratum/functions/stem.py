"""The English Snowball stemmer (Porter2), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWEL = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
# fixed values: the description's exceptional forms and suffix tables
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


SPECIAL, Y_FIRST, VOWEL_IN = re.compile("gener|commun|arsen"), re.compile(f"(^|[{VOWEL}])y"), re.compile(f"[{VOWEL}]")
VOWEL_THEN, SHORT = re.compile(f"[{VOWEL}][^{VOWEL}]"), re.compile(f"(^[{VOWEL}][^{VOWEL}]|[^{VOWEL}][{VOWEL}][^{VOWEL}wxY])$")
PLURALS, PASTS, SECOND, THIRD = ("sses", "ied", "ies", "s", "us", "ss"), ("eed", "eedly", "ed", "edly", "ing", "ingly"), tuple(STEP_2), tuple(STEP_3)


def _regions(word: str) -> tuple[int, int]:
    m = SPECIAL.match(word)
    r1 = m.end() if m else _after(word, 0)
    return r1, _after(word, r1)


def _after(word: str, at: int) -> int:
    """Behind the first consonant that follows a vowel."""
    m = VOWEL_THEN.search(word, at)
    return m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    return bool(SHORT.search(word))


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = Y_FIRST.sub(r"\1Y", w) if "y" in w else w
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    s = _longest(w, PLURALS)
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and VOWEL_IN.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    s = _longest(w, PASTS)
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and VOWEL_IN.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    s = _longest(w, SECOND)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in LI_ENDING else w
        else:
            w = w[: -len(s)] + STEP_2[s]
    s = _longest(w, THIRD)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + STEP_3[s]
    s = _longest(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def terms(text: str) -> list[str]:
    """Stems of runs of ASCII letters, digits, _ and -; both word and stem of two characters or more."""
    found = (m.group().lower() for m in re.finditer("[A-Za-z0-9_-]+", text))
    return [s for w in found if len(w) >= 2 and len(s := stem(w)) >= 2]
