"""Whether the sentences of answers that name persons keep to the claims that they cite, and answers in which those that don't are replaced by the claims' words.

Sentences, citations and claims are rows: sentences meet the claims that they cite in a join, and each is judged by column expressions. Sentences without a
name aren't judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers, ends of sentences, and what looks like a name: two capitalised words.
MARKER, END = r"\[c(\d+)\]", r"(?<=[.!?])\s+(?!\[c\d)"
NAME = r"\b[A-Z][\p{L}'’-]+ [A-Z][\p{L}'’-]+\b"
#: First words that begin no name, and second words that end none.
NO_FIRST = (
    "The This These Those According Sources No It In On United European Russian Ukrainian Iranian Islamic General Colonel President Minister Prime"
).split()
NO_SECOND = (
    "Council Group Ministry Court Bank Sea Bridge Force Forces Guard State Department Region Oblast Republic Federation Union Nations Stream Fleet Corps Brigade "
    "Army Navy Agency Committee Assembly Parliament Service Bureau Office Command District Province City Island Islands Strait Canal Plant Station Korea Prosecutor"
).split()
#: What a sentence asserts, and what must then stand in a claim.
ASSERTED = (
    (r"\bconvict(?:ed|ion)\b", r"\bconvict"),
    (r"\bconfirmed (?:dead|killed)\b|\bdeath (?:is|was|has been) confirmed\b", r"\bconfirm[^.]{0,40}(dead|killed|death)|\b(dead|killed|death)[^.]{0,40}confirm"),
    (r"\b(?:was|were|is|are) (?:reportedly |allegedly )?(?:killed|dead)\b|\bdied\b", r"\bkill|\bdead|\bdeath|\bdied|\bcasualt"),
    (r"\b(?:is|was|remains) (?:sanctioned|designated)\b|\bunder sanctions\b", r"\bsanction|\bdesignat"),
    (r"\b(?:was|is|been) (?:arrested|detained)\b", r"\barrest|\bdetain"),
    (r"\bcharged with\b", r"\bcharge"),
)
#: Attribution, present and past status, identities that are only possible, and denials, which are no evidence of what they deny.
ATTRIBUTED = r"\b(?:according to|reportedly|reported(?:ly)?|claimed?|allegedly|sources? (?:say|said|claim)|per\b)"
CURRENT = r"\b(?:is|remains?) (?:currently |still )?(?:sanctioned|designated|listed|on the .{0,20}list)\b"
EXPIRED = (
    r"\b(?:removed|delisted|lifted|expired|revoked|overturned|former(?!\s+(?:deputy\s+|prime\s+|vice\s+|first\s+)?(?:minister|official|governor|deputy|head|chief|president|"
    r"director|commander|ambassador|senator|mayor|officer|spokes\w+|advis[eo]r|lawmaker|general|colonel|admiral)))\b"
)
CANDIDATE = r"\b(?:name-only|candidate match|possible (?:name )?match|potential match|identity (?:was |is )?not (?:yet )?resolved)\b"
SAID_OPEN, STATUS_WORD = r"\bcandidate\b|\bpossible\b|\bpotential\b|\bunresolved\b", r"\bsanction|\bdesignat"
DENIED = r"\b(?:distinct from|not|never|no|excluded from|rather than)\s+(?:\w+\s+){0,3}?(?:(?:sanction|designat|convict|arrest|detain|charge|kill|dead|death|died)\w*\s*)+"
HEDGED = ("claimed", "unverified")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _at(text: Column, pattern: str) -> Column:
    """Where the first match begins; null without one."""
    return F.nullif(F.regexp_instr(text, F.lit(f"(?i){pattern}")), F.lit(0))


def names(sentence: Column) -> Column:
    """The different names in a sentence."""
    found = F.regexp_extract_all(F.regexp_replace(sentence, MARKER, ""), F.lit(NAME), F.lit(0))
    return F.array_distinct(F.filter(found, lambda n: ~F.substring_index(n, " ", 1).isin(NO_FIRST) & ~F.substring_index(n, " ", -1).isin(NO_SECOND)))


def named_in(name: Column, text: Column) -> Column:
    """Whether lower-case text has the name, or its last word soon after a word of the same initial as its first."""
    first, last = F.lower(F.substring_index(name, " ", 1)), F.lower(F.substring_index(name, " ", -1))
    at = F.position(last, text)
    before = F.substring(text, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)))
    initial = F.exists(F.filter(F.split(before, r"[^\p{L}'’-]+"), lambda t: F.length(t) > 1), lambda t: F.substring(t, 1, 1) == F.substring(first, 1, 1))
    return text.contains(F.lower(name)) | ((F.length(last) >= 3) & (at > 0) & initial)


def judged(answers: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """key, place, sentence, kind and claim of sentences that fail, in their order: kind is identity, certainty, predicate or status, claim the first cited one (null without one).

    answers has key and answer, claims has key, claim (a number), text and hedging: what an answer may cite. Null answers have no sentences; markers without a claim count for
    nothing but that there are some.
    """
    rows = answers.select(key, F.posexplode(F.split("answer", END)).alias("place", "sentence"))
    rows = rows.select("*", names(F.col("sentence")).alias("names"), F.transform(F.regexp_extract_all("sentence", F.lit(MARKER), F.lit(1)), lambda x: x.cast("bigint")).alias("ids")).where(F.size("names") > 0)
    cited = rows.select(key, "place", F.posexplode("ids").alias("nth", "claim")).join(claims.select(key, "claim", F.col("text").alias("said"), "hedging"), [key, "claim"])
    listed = F.array_sort(F.collect_list(F.struct("nth", "claim", "said", "hedging")))
    about = cited.groupBy(key, "place").agg(listed.alias("c"))
    both = rows.join(about, [key, "place"], "left").select("*", F.coalesce(F.array_join(F.transform("c", lambda c: c.getField("said")), "\n"), F.lit("")).alias("evidence"))
    s, e, asserts = F.col("sentence"), F.col("evidence"), F.least(*[_at(F.col("sentence"), a) for a, _ in ASSERTED])
    proof = F.regexp_replace(e, f"(?i){DENIED}", " ")
    alone = F.col("c").isNull()
    unknown = F.exists("names", lambda n: ~named_in(n, F.lower(F.col("evidence"))))
    only_possible = _has(e, CANDIDATE) & _has(s, STATUS_WORD) & asserts.isNotNull() & ~_has(s, CANDIDATE) & ~_has(s, SAID_OPEN)
    unproven = reduce(lambda x, y: x | y, [_has(s, a) & ~_has(proof, p) for a, p in ASSERTED])
    outdated = _has(s, CURRENT) & _has(e, EXPIRED) & ~_has(s, EXPIRED)
    doubtful = F.forall("c", lambda c: c.getField("hedging").isin(*HEDGED)) & asserts.isNotNull() & ~F.coalesce(_at(s, ATTRIBUTED) < asserts, F.lit(False))
    kind = (
        F.when(alone, F.when((F.size("ids") > 0) | asserts.isNotNull(), "identity"))
        .when(unknown, "identity")
        .when(only_possible, "certainty")
        .when(unproven, "predicate")
        .when(outdated, "status")
        .when(doubtful, "certainty")
    )
    return both.select(key, "place", "sentence", kind.alias("kind"), F.get("c", 0).getField("claim").alias("claim"), F.get("c", 0).getField("said").alias("said")).where("kind is not null")


def replacement(said: Column, claim: Column) -> Column:
    """A claim's own words as a sentence, without markers that it may hold; nothing for no claim."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(said, MARKER, ""), r"\s+", " ")), r"\.$", "")
    return F.coalesce(F.concat(F.lit('Sources state: "'), plain, F.lit('." [c'), claim.cast("string"), F.lit("]")), F.lit(""))


def faithful(answers: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """key, answer and replaced (how many sentences): answers in which each sentence that fails gives way to its first cited claim; others are as they were."""
    failed = judged(answers, claims, key).select(key, "place", "sentence", replacement(F.col("said"), F.col("claim")).alias("now"))
    listed = failed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "now"))).alias("f"))

    def put(text: Column, f: Column) -> Column:
        at = F.position(f.getField("sentence"), text)
        whole = F.concat(F.substring(text, F.lit(1), at - 1), f.getField("now"), F.substring(text, at + F.length(f.getField("sentence")), F.length(text)))
        return F.when(at > 0, whole).otherwise(text)

    tidy = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]{2,}", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    both = answers.select(key, "answer").join(listed, key, "left")
    said = F.when(F.col("f").isNull(), F.col("answer")).otherwise(tidy(F.aggregate("f", F.col("answer"), put)))
    return both.select(key, said.alias("answer"), F.when(F.col("f").isNull(), 0).otherwise(F.size("f")).alias("replaced"))
