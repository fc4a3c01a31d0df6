"""The English Snowball stemmer ("Porter2"), after its published definition. Words are few; texts are never stemmed one by one."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
#: Words that lexemes leave out.
STOP = set(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now".split()
)
#: Whole words with a stem of their own, and those that are left as they are.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
LATE_SAME = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings and what they become, in the order of the definition's steps 2, 3 and 4.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _region(word: str) -> int:
    """Where what follows the first consonant after a vowel begins."""
    m = re.search(f"[{VOWELS}][^{VOWELS}]", word)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Ends in a short syllable."""
    return bool(re.search(f"(^|.*[^{VOWELS}])[{VOWELS}][^{VOWELS}wxY]$", word)) if len(word) > 2 else bool(re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word; other letters than a to z are left as they are."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in SAME:
        return word
    w = re.sub(f"(^y|(?<=[{VOWELS}])y)", "Y", word.removeprefix("'"))
    known = re.match("gener|commun|arsen", w)
    r1 = known.end() if known else _region(w)
    r2 = r1 + _region(w[r1:])
    # 0: possessives
    w = re.sub("'s'$|'s$|'$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", w[:-1]):
        w = w[:-1]
    if w in LATE_SAME:
        return w
    # 1b: past and present
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(f"[{VOWELS}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    end = _ending(w, (*STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + STEP2[end]
    # 3
    end = _ending(w, (*STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + STEP3[end]
    # 4
    end = _ending(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
