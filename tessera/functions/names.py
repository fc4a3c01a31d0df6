"""Names of persons and organisations: one key for what is spelled in different ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters in Latin ones.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "yu", "я": "ya", "ь": "", "ъ": "",
}
#: Titles before names; spellings of one actor (normalised spelling, key).
HONORIFICS = "ayatollah seyyed sayyid sheikh dr mr mrs president general colonel grand".split()
ALIASES = {
    "houthi": "houthis",
    "houthi fighters": "houthis",
    "houthi rebels": "houthis",
    "houthi movement": "houthis",
    "iranian revolutionary guard corps": "islamic revolutionary guard corps",
    "irgc": "islamic revolutionary guard corps",
    "russian forces": "russian armed forces",
    "russian military": "russian armed forces",
    "ukrainian forces": "ukrainian armed forces",
    "ukrainian military": "ukrainian armed forces",
    "ukrainian air defense forces": "ukrainian air defense",
    "irans intelligence ministry": "iranian intelligence ministry",
    "israeli supreme court": "supreme court of israel",
    "un": "united nations",
    "russian ministry of defense": "russian mod",
    "russian defense ministry": "russian mod",
    "andrei vorobev": "andrei vorobyov",
}
#: Patterns of what isn't a named actor, with the reason.
JUNK = (
    (r"^(unnamed|unidentified|unknown|anonymous|ex-|former)\b", "unnamed"),
    (
        r"\b(individuals?|civilians|citizens|officials|activists|mourners|assailants|protesters|soldiers|personnel|commanders|residents|employees|schoolboy|pilots|settlers|partisans|fighters|rebels|"
        r"troops|units|drones|companies|courts|governments|authorities|positions|national)$",
        "collective",
    ),
)
COUNTED = r"^(one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s"
WEAPON = r"^(su|mig|tu|s|kh|fab|x)-\d+\w*$"


def normalized(name: Column) -> Column:
    """Lower case in Latin letters, without punctuation and titles, with one form of common endings."""
    n = F.lower(F.trim(name))
    one = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    n = F.translate(n, "".join(one) + "ьъ", "".join(one.values()))
    for letter, latin in CYRILLIC.items():
        if len(latin) > 1:
            n = F.replace(n, F.lit(letter), F.lit(latin))
    n = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(n, "[-–]", " "), r"[^\p{L}\p{N} ]", ""), r"\s+", " "))
    n = F.regexp_replace(n, rf"^((?:{'|'.join(HONORIFICS)}) )+(?=.)", "")
    ending = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "ey$", "ei"), "yy$", "y"), "iy$", "y"), "ii$", "i")
    return F.array_join(F.transform(F.split(n, " "), ending), " ")


def key(name: Column) -> Column:
    """The normalised name, or the key of the actor that it is a spelling of."""
    n = normalized(name)
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(alias, n), n)


def junk_reason(name: Column, kind: Column, places: list[str]) -> Column:
    """Why a name isn't a named actor; null if it may be one."""
    n = F.lower(F.trim(name))
    return (
        F.when(normalized(name).isin(list(ALIASES)), F.lit(None).cast("string"))
        .when(n.isin(places), "geography")
        .when(n.rlike(WEAPON), "object")
        .when(n.rlike(JUNK[0][0]), JUNK[0][1])
        .when(n.rlike(COUNTED) & (kind == "person"), "counted")
        .when(n.rlike(JUNK[1][0]), JUNK[1][1])
        .when(n.rlike(r"\s+in\s+") & (kind != "agency"), "descriptive")
    )
