"""Places and kinds of action that a text names, in three languages, and how well two texts' signatures match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Places and their spellings.
TOPONYMS = {
    "pokrovsk": ["pokrovsk", "покровск", "покровськ", "krasnoarmeysk", "красноармейск"],
    "toretsk": ["toretsk", "торецк", "торецьк", "dzerzhinsk"],
    "kupyansk": ["kupyansk", "kupiansk", "купянск", "куп'янськ", "купʼянськ"],
    "chasiv_yar": ["chasiv yar", "часов яр", "часів яр"],
    "kostyantynivka": ["kostyantynivka", "konstantinovka", "константиновка", "костянтинівка"],
    "lyman": ["lyman", "лиман"],
    "siversk": ["siversk", "северск", "сіверськ"],
    "sloviansk": ["sloviansk", "славянск", "слов'янськ"],
    "kramatorsk": ["kramatorsk", "краматорск", "краматорськ"],
    "vovchansk": ["vovchansk", "волчанск", "вовчанськ"],
    "kharkiv": ["kharkiv", "харьков", "харків"],
    "sumy": ["sumy", "сумы", "суми"],
    "zaporizhzhia": ["zaporizhzhia", "запорожье", "запоріжжя", "orikhiv", "оріхів", "орехов"],
    "kherson": ["kherson", "херсон"],
    "donetsk": ["donetsk", "донецк", "донецьк"],
    "luhansk": ["luhansk", "луганск", "луганськ"],
    "velykyi_burluk": ["velykyi burluk", "великий бурлук"],
    "novopavlivka": ["novopavlivka", "новопавловка", "новопавлівка"],
    "velyka_novosilka": ["velyka novosilka", "великая новоселка", "велика новосілка"],
    "hulyaipole": ["hulyaipole", "гуляйполе"],
    "kyiv": ["kyiv", "киев", "київ"],
    "odesa": ["odesa", "odessa", "одесса", "одеса"],
    "dnipro": ["dnipro", "днепр", "дніпро", "dnipropetrovsk"],
    "crimea": ["crimea", "крым", "крим", "sevastopol", "севастополь"],
    "moscow": ["moscow", "москва"],
    "belgorod": ["belgorod", "белгород", "бєлгород"],
    "kursk": ["kursk", "курск", "курськ"],
    "bryansk": ["bryansk", "брянск", "брянськ"],
    "rostov": ["rostov", "ростов"],
    "ryazan": ["ryazan", "рязань"],
    "tatarstan": ["tatarstan", "татарстан", "yelabuga", "елабуга"],
    "st_petersburg": ["petersburg", "петербург", "spief", "пмэф"],
    "dubna": ["dubna", "дубна"],
    "north_korea": ["north korea", "dprk", "кндр", "северная корея", "північна корея"],
}
#: Kinds of action and the parts of words that tell them.
ACTIONS = {
    "strike": (
        ["strike", "missile", "drone", "shahed", "geran", "attack", "hit", "удар", "ракет", "дрон", "шахед", "геран", "бпла", "uav", "обстрел", "обстріл", "атак", "вибух", "взрыв"]
        + ["explosion", "fire at", "fire broke", "refinery fire", "пожар", "пожеж"]
    ),
    "advance": ["advance", "assault", "captur", "seiz", "liberat", "наступ", "штурм", "просунул", "просував", "зайня", "захват", "звільн", "освобо", "offensive"],
    "air_defense": ["air defense", "intercept", "shot down", "downed", "пво", "ппо", "збит", "сбит", "перехват", "перехопл"],
    "political": (
        ["putin", "zelensky", "kremlin", "negotiat", "sanction", "путин", "путін", "зеленск", "зеленськ", "кремл", "переговор", "санкц", "ceasefire", "мобилизац", "мобілізац"]
    ),
    "casualties": ["casualt", "losses", "killed", "потер", "втрат", "загибл", "погиб"],
}
#: Towns of the regions that summaries name, and the places inside Russia and on both sides; the others are inside Ukraine.
TOWNS = {
    "donetsk": ["pokrovsk", "toretsk", "chasiv_yar", "kostyantynivka", "lyman", "siversk", "sloviansk", "kramatorsk", "velyka_novosilka", "novopavlivka"],
    "kharkiv": ["kupyansk", "vovchansk", "velykyi_burluk"],
    "zaporizhzhia": ["hulyaipole"],
}
RUSSIAN = ["moscow", "belgorod", "kursk", "bryansk", "rostov", "ryazan", "tatarstan", "st_petersburg", "dubna"]
BOTH = ["crimea", "north_korea"]
#: The score of a match, which needs a place.
MATCH = 0.6


def _named(text: Column, lexicon: dict[str, list[str]]) -> Column:
    def any_of(low: Column, parts: list[str]) -> Column:
        found = F.contains(low, F.lit(parts[0]))
        for p in parts[1:]:
            found = found | F.contains(low, F.lit(p))
        return found

    # the lower case once for all words, not once for each
    return let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), lambda low: F.array_compact(F.array(*[F.when(any_of(low, parts), F.lit(name)) for name, parts in lexicon.items()])))


def toponyms(text: Column) -> Column:
    return _named(text, TOPONYMS)


def actions(text: Column) -> Column:
    return _named(text, ACTIONS)


def expanded(places: Column) -> Column:
    """Places with the towns of regions among them."""
    towns = F.create_map(*[x for k, v in TOWNS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.array_distinct(F.concat(places, F.flatten(F.transform(places, lambda p: F.coalesce(F.element_at(towns, p), F.array().cast("array<string>"))))))


def side(places: Column) -> Column:
    """Which side covers a text with these places: ru, ua or both."""
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    ru, both = F.arrays_overlap(places, lit(RUSSIAN)), F.arrays_overlap(places, lit(BOTH))
    ua = F.size(F.array_except(places, lit([*RUSSIAN, *BOTH]))) > 0
    return F.when(both | (ru == ua), "both").when(ru, "ru").otherwise("ua")


def match_score(places: Column, other_places: Column, acts: Column, other_acts: Column) -> Column:
    """From 0 to 1: shared places count most, shared actions refine; actions alone are a quarter."""
    shared, act = F.size(F.array_intersect(places, other_places)), F.size(F.array_intersect(acts, other_acts)) > 0
    with_place = F.least(F.lit(1.0), F.lit(0.5) + F.least(F.lit(1.0), shared / 2) * 0.25 + F.when(act, 0.25).otherwise(0.0))
    return F.when(shared > 0, with_place).when(act, F.lit(0.25)).otherwise(F.lit(0.0))
