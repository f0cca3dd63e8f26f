"""English stems by the algorithm of Porter (1980), with its author's later departures."""

from __future__ import annotations

from functools import lru_cache

#: Endings and what takes their place, in the algorithm's steps 2, 3 and 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; ``y`` is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    return _shape(stem).count("vc")


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    # 1a: plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and present participles.
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    elif (end := _ending(word, ("ed", "ing"))) and _vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    # 1c: a final y after a vowel in the stem.
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    # 2 and 3: double and single endings, after a stem of measure 1 or more.
    for table in (STEP_2, STEP_3):
        if (end := _ending(word, table)) and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    # 4: what is left of an ending, after a measure of 2 or more; ion only after s or t.
    if (end := _ending(word, STEP_4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    # 5: a final e, and one of two l.
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
