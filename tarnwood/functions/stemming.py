"""English stems, as the published Snowball "English" (Porter2) description gives them, and the words that a search ignores.

A small helper for single words: callers keep what it gives for the distinct
words of a batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words without weight in a search.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Words with a stem of their own, and words that stay.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_OWN |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STAY = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: The endings of each step, and what stands for them; the longest that fits counts.
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"), "")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_VOWELS = "aeiouy"

_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_SHORT_END = re.compile(f"(?:[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|^[{_VOWELS}][^{_VOWELS}])$")
_Y = re.compile(f"(?:^|(?<=[{_VOWELS}]))y")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin in which endings may be cut."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _plural(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _has_vowel(word[:-2]) else word


def _past(word: str, first: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    rest = word[: -len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= first else word
    if not _has_vowel(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(_DOUBLE):
        return rest[:-1]
    return rest + "e" if len(rest) <= first and _SHORT_END.search(rest) else rest


def _replaced(word: str, endings: dict[str, str], start: int, second: int) -> str:
    """One step over ``endings`` that lie in the region from ``start``."""
    end = _ending(word, endings)
    if end is None or len(word) - len(end) < start:
        return word
    rest = word[: -len(end)]
    before = rest[-1:]
    allowed = {"li": before in "cdeghkmnrt", "ogi": before == "l", "ative": len(rest) >= second, "ion": before in "st"}
    return rest + endings[end] if before and allowed.get(end, True) else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters or of digits mostly stay as they are."""
    word = word.removeprefix("'")
    if len(word) <= 2 or word in _OWN:
        return _OWN.get(word, word)
    word = _Y.sub("Y", word)
    first, second = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word.removesuffix(end)
            break
    word = _plural(word)
    if word in _STAY:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _replaced(word, _SECOND, first, second)
    word = _replaced(word, _THIRD, first, second)
    word = _replaced(word, _FOURTH, second, second)
    if word.endswith("e") and (len(word) > second or len(word) > first and not _SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.replace("Y", "y")
