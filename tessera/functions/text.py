"""Text functions as column expressions: they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no claim (token sets).
STOPWORDS = (
    "the a an of in on to and or for with at by from as that this these those its their his her is are was were be been being "
    "has have had will would into over after before during near about"
).split()
#: Ordered rules for how a sentence hedges; the first that matches gives the class and the cue.
HEDGING_RULES = (
    ("unverified", r"(cannot (?:independently )?(?:verify|confirm))"),
    ("unverified", r"(has not (?:yet )?(?:observed|verified|confirmed))"),
    ("unverified", r"(unverified|unconfirmed) (?:footage|images?|reports?|claims?)"),
    ("unverified", r"\b(purported(?:ly)?)\b"),
    ("confirmed", r"(geolocated (?:footage|imagery|images?|video|photos?))"),
    ("confirmed", r"(footage (?:published|posted).{0,40}(?:shows|showing|confirms))"),
    ("confirmed", r"(visually confirmed|visual confirmation)"),
    ("confirmed", r"(satellite imagery (?:shows|showing|confirms|captured))"),
    ("confirmed", r"\b(confirmed)\b"),
    ("assessed", r"(ISW (?:assesses|assessed|has assessed|continues to assess))"),
    ("assessed", r"(ISW (?:has )?previously (?:assessed|reported|observed|noted))"),
    ("assessed", r"\b(likely|probably|almost certainly|possibly)\b"),
    ("claimed", r"\b(claimed|claims|claiming)\b"),
    ("claimed", r"\b(reportedly|allegedly|according to)\b"),
    ("claimed", r"\b(reported|reporting) that\b"),
    ("claimed", r"\b(stated|said|announced|asserted|denied|acknowledged|warned|amplified|told)\b"),
    ("claimed", r"\b(sources? (?:reported|indicated))\b"),
)
#: Of each rule, parts of words (lower case) of which any match has one: they are looked for first, since most sentences have none.
HEDGING_PARTS = (
    ("cannot",), ("has not",), ("unverified", "unconfirmed"), ("purported",), ("geolocated",), ("footage",), ("visual",), ("satellite imagery",), ("confirmed",), ("isw ",), ("isw ",),
    ("likely", "probably", "almost certainly", "possibly"), ("claim",), ("reportedly", "allegedly", "according to"), ("reported that", "reporting that"),
    ("stated", "said", "announced", "asserted", "denied", "acknowledged", "warned", "amplified", "told"), ("source",),
)
#: How much each hedging class says for a source.
HEDGING_WEIGHTS = {"confirmed": 1.0, "assessed": 0.75, "unknown": 0.5, "claimed": 0.4, "unverified": 0.15}
#: Classes from the strongest on.
HEDGING_LADDER = ("confirmed", "claimed", "unverified", "assessed", "unknown")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda, Catalyst would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(text: Column) -> Column:
    """Lower case, without URLs, only letters, digits and single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), r"[^\p{L}\p{N} ]", " ")
    return F.trim(F.regexp_replace(bare, " {2,}", " "))


def word_shingles(text: Column, size: int = 3) -> Column:
    """The distinct runs of `size` words; the whole text if it has fewer words, nothing if it has none."""
    words = F.filter(F.split(normalized(text), " "), lambda w: w != "")

    def runs(words: Column) -> Column:
        all_runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        some = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(words) >= size, F.array_distinct(all_runs)).otherwise(some)

    return let(words, runs)


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of two or more characters or with a digit, without stop-words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", " "), r"\s+")
    keep = lambda w: ((F.length(w) >= 2) | w.rlike("[0-9]")) & ~w.isin(STOPWORDS) & (w != "")
    return F.array_distinct(F.filter(words, keep))


def question_terms(text: Column, stopwords: list[str], most: int = 8) -> Column:
    """The first distinct words of over two characters that aren't stop-words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stopwords))), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def content_md5(text: Column) -> Column:
    """md5 of the text with white space squeezed: equal for exact mirrors."""
    return F.md5(F.trim(F.regexp_replace(text, r"\s+", " ")))


def content_hash(adapter: Column, external_id: Column, title: Column, content: Column) -> Column:
    """The key of an ingested document: sha256 over adapter, id, title and the first 4000 characters."""
    parts = [F.coalesce(c, F.lit("")) for c in (adapter, external_id, title)]
    return F.sha2(F.concat_ws("|", *parts, F.substring(F.coalesce(content, F.lit("")), 1, 4000)), 256)


def ended_sentences(text: Column) -> Column:
    r"""Matches of [^.\n]+\. by one pass: that pattern itself would be tried anew at each character of a line without an end."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^.\n]+\.?"), F.lit(0)), lambda s: s.endswith("."))


def hedging(sentence: Column) -> Column:
    """The class of the first rule that matches, else unknown."""

    def matched(low: Column) -> Column:
        some = lambda parts: reduce(lambda found, p: found | F.contains(low, F.lit(p)), parts[1:], F.contains(low, F.lit(parts[0])))
        return F.coalesce(*[F.when(some(parts) & sentence.rlike(f"(?i){pattern}"), F.lit(kind)) for (kind, pattern), parts in zip(HEDGING_RULES, HEDGING_PARTS)], F.lit("unknown"))

    return let(F.lower(sentence), matched)


def hedging_cue(sentence: Column) -> Column:
    """What the first matching rule's group matched, at most 60 characters; null without one."""
    return F.coalesce(*[F.when(sentence.rlike(f"(?i){p}"), F.substring(F.regexp_extract(sentence, f"(?i){p}", 1), 1, 60)) for _, p in HEDGING_RULES])


def hedging_weight(kind: Column) -> Column:
    return reduce(lambda w, item: w.when(kind == item[0], F.lit(item[1])), list(HEDGING_WEIGHTS.items())[1:], F.when(kind == "confirmed", F.lit(1.0)))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def detect_language(text: Column) -> Column:
    """A language by its script and a few letters; null where there is too little of any script."""
    cyrillic, arabic, latin = count_of(text, "Ѐ-ӿ"), count_of(text, "؀-ۿ"), count_of(text, "a-zA-Z")
    return (
        F.when((cyrillic < 5) & (latin < 5) & (arabic < 5), F.lit(None).cast("string"))
        .when((arabic >= 5) & (arabic >= cyrillic) & (arabic >= latin), F.when(text.rlike("[پچژگکی]"), "fa").otherwise("ar"))
        .when(cyrillic <= latin, "en")
        .when(text.rlike("(?iu)[ӑӗӳ]|ҫак|тата") & text.rlike("[ҫ]"), "cv")
        .when(text.rlike("[ҡғҙ]"), "ba")
        .when(text.rlike("[җ]") & text.rlike("[әөү]"), "tt")
        .when(text.rlike("[ӏ]"), "ce")
        .when(count_of(text, "іїєґІЇЄҐ") > count_of(text, "ыъэёЫЪЭЁ"), "uk")
        .otherwise("ru")
    )


def is_meta_claim(text: Column) -> Column:
    """Claims about the document, not the world."""
    t = F.trim(text)
    return t.rlike(r"(?i)^no (significant|relevant|specific|notable)\b.*\bclaims?\b") | (t.rlike(r"(?i)^no\b") & t.rlike(r"(?i)\bin (this|the) document\b"))


def _tenths(value: Column) -> Column:
    """A double of 1 or more with one decimal place, rounded by its binary value; ties go to the even digit. (format_string rounds the shortest decimal, ties up.)"""
    whole = F.floor(value)
    part = ((value - whole) * F.lit(2.0**52)).cast("bigint") * 10  # exact: 52 bits are behind the point at most
    tenths, rest, half = F.shiftright(part, 52), part.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(1 << 51)
    up = F.when((rest > half) | ((rest == half) & (tenths % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    found = whole * 10 + tenths + up
    return F.when(value < 2.0**52, F.concat(F.floor(found / 10).cast("string"), F.lit("."), (found % 10).cast("string"))).otherwise(F.format_string("%.1f", value))


def magnitude(value: Column) -> Column:
    """1.2B, 35M, 7K; halves go to the even digit, and null to null."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value >= 1e9, F.concat(_tenths(value / 1e9), F.lit("B")))
        .when(value >= 1e6, F.concat(F.format_string("%.0f", F.rint(value / 1e6)), F.lit("M")))
        .otherwise(F.concat(F.format_string("%.0f", F.rint(value / 1e3)), F.lit("K")))
    )


def display_name(*choices: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices])


def prefix_key(text: Column, size: int = 60) -> Column:
    """The start of the normalised text: equal for slightly different wordings of one claim."""
    return F.substring(normalized(text), 1, size)


def cache_key(question: Column, *parts: Column) -> Column:
    """sha256 over the squeezed question without closing punctuation, and what else the answer hangs on."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")), r"[?.!]+$", "")
    return F.sha2(F.to_json(F.array(plain, *[p.cast("string") for p in parts])), 256)
