"""From candidates to an answer: rerank results, trims, coverage at publication, gates, and what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of allegations against persons, those that can do the most harm, and words that attribute.
ALLEGATION = (
    r"(?i)\bdie(?:d|s)\b|\bdeaths?\b|\bdead\b|\bkilled\b|\bsuicide\b|\bassassinat\w*|\bcorrupt\w*|\bbriber\w*|\bembezzl\w*|\bfraud\w*|\blaunder\w*|\bcriminal\w*|\barrest\w*|\bdetain\w*|\bprosecut\w*|"
    r"\bindict\w*|\bcharged\b|\bconvict\w*|\bsentenced\b|\btreason\w*|\bespionage\b|\bsanction\w*|\bpurged?\b|\bdismiss\w*|\bfired\b|\bousted\b|\bhospitaliz\w*|\bgravely ill\b|\bcoma\b|\boverdose\b|\bpoison\w*"
)
REPUTATIONAL = r"(?i)\b(corrupt|briber|embezzl|fraud|launder|crimin|prosecut|indict|convict|treason|espionage|blackmail|suicide|overdose|poison|gravely ill|hospitaliz|coma)\w*"
ATTRIBUTED = (
    r"(?i)\b(claims?|claimed|says?|said|stated?|announced?|reports?|reported(?:ly)?|according to|alleged(?:ly)?|denies|denied|asserts?|asserted|purported(?:ly)?|suggests?|suggested|unverified|unconfirmed)\b|^sources?\b"
)
#: Classes that are disputed, with what is put before such claims.
LABELS = {"claimed": "Sources claim:", "unverified": "Unverified reporting:", "unknown": "Unverified reporting:"}
#: A disputed allegation against a person needs so many documents.
LEAST_DOCUMENTS = 2
#: A rerank that gives fewer than half the ids asked for isn't used; answers keep so many claims at least.
FLOOR = 8


def governed(text: Column) -> Column:
    """Whether an attribution comes before the first word of an allegation (or there is no allegation)."""
    at = lambda pattern: F.regexp_instr(text, F.lit(pattern))
    return (at(ATTRIBUTED) > 0) & ((at(ALLEGATION) == 0) | (at(ATTRIBUTED) < at(ALLEGATION)))


def publication(text: Column, names_person: Column, hedging: Column, documents: Column) -> Column:
    """drop, attribute or publish: disputed harmful allegations need documents, other disputed ones an attribution that governs."""
    disputed = hedging.isin(*LABELS)
    return (
        F.when(names_person & disputed & text.rlike(REPUTATIONAL) & (documents < LEAST_DOCUMENTS), "drop")
        .when(names_person & disputed & text.rlike(ALLEGATION) & ~governed(text), "attribute")
        .otherwise("publish")
    )


def reranked(candidates: Column, given: Column, k: int) -> Column:
    """The first k of the ids given (known ones, once each), filled up from the candidates' own order; only that order if fewer than
    half of k are valid."""
    valid = F.filter(F.array_distinct(given), lambda i: F.array_contains(candidates, i))
    enough = F.size(valid) >= (k + 1) // 2
    return F.slice(F.when(enough, F.array_distinct(F.concat(valid, candidates))).otherwise(candidates), 1, k)


def trimmed(ids: Column, relevant: Column) -> Column:
    """As many as are relevant, but the floor at least; all if that isn't known."""
    return F.when(relevant.isNull(), ids).otherwise(F.slice(ids, F.lit(1), F.greatest(relevant, F.lit(FLOOR))))


def related(candidates: DataFrame, cited: DataFrame, key: str, score: str, least: float = 0.5, most: int = 5) -> DataFrame:
    """The best candidates of a score that the answer doesn't cite."""
    return candidates.join(cited.select(key), key, "left_anti").where(F.col(score) >= least).orderBy(F.desc(score), key).limit(most)


def at_publish(matches: DataFrame, keys: list[str], fetched: str, published: str, asked: Column) -> DataFrame:
    """Per digest: matches, those whose evidence was fetched by the time of publication, and their share of what was asked for."""
    before = F.count_if(F.col(fetched) <= F.col(published))
    found = matches.groupBy(*keys).agg(F.count("*").alias("matched"), before.alias("matched_before"), F.max(asked).alias("asked"))
    return found.withColumn("coverage_pct", F.round(F.try_divide(F.col("matched_before") * F.lit(100.0), "asked"), 1))


def gate(old: DataFrame, new: DataFrame, recall_points: float = 15.0, honesty: float = 0.8) -> DataFrame:
    """One row: whether new (recall_pct, honesty, citation_pct) passes against old."""
    both = old.select(F.col("recall_pct").alias("r0"), F.col("citation_pct").alias("c0")).join(F.broadcast(new.select(F.col("recall_pct").alias("r1"), F.col("citation_pct").alias("c1"), "honesty")))
    recall, honest = (F.col("r1") - F.col("r0")) >= recall_points, F.coalesce(F.col("honesty") >= honesty, F.lit(False))
    citation = F.col("c0").isNull() | F.coalesce(F.col("c1") >= F.col("c0"), F.lit(False))
    return both.select(F.round(F.col("r1") - F.col("r0"), 2).alias("recall_delta"), recall.alias("recall_pass"), honest.alias("honesty_pass"), citation.alias("citation_pass"), (recall & honest & citation).alias("passed"))


def cells(countries: DataFrame, tracks: str = "tracks") -> DataFrame:
    """Each country with each track that it is configured for."""
    return countries.select("country", F.explode(tracks).alias("track"))


#: Words that ask for another theater, time or actor than a conversation's evidence has.
THEATERS = {"ru": r"(?i)\brussia|russian\b", "ua": r"(?i)\bukraine|ukrainian\b", "ir": r"(?i)\biran|iranian\b", "il": r"(?i)\bisrael|israeli\b"}
TIMES = (
    r"(?i)\b(?:january|february|march|april|june|july|august|september|october|november|december)\b|\b(?:in|last|this|early|late|since|during|until|through)\s+may\b|"
    r"\b\d{4}-\d{2}-\d{2}\b|\b(?:yesterday|today|last week|this week|past \d+ days?)\b"
)
ACTORS = r"\b[A-Z][a-z][\p{L}'’-]+(?: [A-Z][\p{L}'’-]+)?\b"
LEADING = "What Which Who When Where How Why Did Does Has Have Was Were Is Are The Can Could Would".split()


def followup_scope(question: Column, theaters: Column, evidence: Column) -> Column:
    """Whether a further question is answered from the evidence at hand (its theaters, an array, and its text): new, expand or reuse."""
    other = F.lit(False)
    for name, words in THEATERS.items():
        other = other | (question.rlike(words) & ~F.coalesce(F.array_contains(theaters, name), F.lit(False)))
    actors = F.regexp_extract_all(question, F.lit(ACTORS), F.lit(0))
    leads = lambda a: F.substring_index(a, " ", 1).isin(LEADING)
    own = F.filter(F.transform(actors, lambda a: F.when(leads(a), F.when(a.contains(" "), F.regexp_replace(a, r"^\S+ ", ""))).otherwise(a)), lambda a: a.isNotNull())
    unknown = F.exists(own, lambda a: ~F.contains(F.lower(evidence), F.lower(a)))
    return F.when(other, "new").when(question.rlike(TIMES) | unknown, "expand").otherwise("reuse")


def refusal(apply: Column, acknowledged: Column, complete: Column, covered_from: Column, covered_to: Column, first: Column, last: Column) -> Column:
    """Why days (first to last, both included) may not be made again yet, or null: the first condition that fails. complete is null without a checkpoint."""
    return (
        F.when(~apply, F.lit(None).cast("string"))
        .when(~acknowledged, "not acknowledged")
        .when(complete.isNull(), "no checkpoint")
        .when(~complete, "not complete")
        .when(first.isNull() | last.isNull(), "invalid dates")
        .when((covered_from > first) | (covered_to < F.date_add(last, 1)), "not covered")
    )


def guarded(claims: DataFrame, titles: DataFrame) -> DataFrame:
    """event, title, claims, dropped and rule (rebuilt, labelled, kept) of events (event, title) with their claims (event, claim, text, hedging,
    documents, person).

    Claims that publication() drops are gone, and those it attributes get a label. An event with a disputed allegation, kept or dropped, gets the text of
    its longest claim as title, with a label where that is disputed and not attributed; one of disputed claims only, whose title has no
    attribution, gets a label. Events without claims are gone.
    """
    disputed = F.col("hedging").isin(*LABELS)
    label = F.when(F.col("hedging") == "claimed", LABELS["claimed"]).otherwise(LABELS["unknown"])
    allegation = disputed & F.col("person") & F.col("text").rlike(ALLEGATION)
    verdict = publication(F.col("text"), F.col("person"), F.col("hedging"), F.col("documents"))
    said = F.when(verdict == "attribute", F.concat_ws(" ", label, "text")).otherwise(F.col("text"))
    rows = claims.select("event", "claim", "hedging", disputed.alias("disputed"), allegation.alias("allegation"), verdict.alias("verdict"), said.alias("text"))
    copy = F.when(F.col("disputed") & ~governed(F.col("text")), F.concat_ws(" ", label, "text")).otherwise(F.col("text"))
    stays = F.col("verdict") != "drop"
    found = rows.groupBy("event").agg(
        F.sort_array(F.collect_list(F.when(stays, F.col("claim")))).alias("claims"),
        F.count_if(~stays).alias("dropped"),
        F.bool_or("allegation").alias("bad"),
        F.bool_and(F.when(stays, F.col("disputed"))).alias("open"),
        F.bool_or(stays & (F.col("hedging") == "claimed")).alias("claimed"),
        F.max_by(copy, F.when(stays, F.struct(F.length("text"), -F.col("claim")))).alias("copy"),
    )
    attributed = F.col("title").rlike(ATTRIBUTED)
    rule = F.when(F.col("bad"), "rebuilt").when(F.col("open") & ~attributed, "labelled").otherwise("kept")
    whole = F.when(F.col("claimed"), LABELS["claimed"]).otherwise(LABELS["unknown"])
    title = F.when(rule == "rebuilt", F.col("copy")).when(rule == "labelled", F.concat_ws(" ", whole, "title")).otherwise(F.col("title"))
    some = found.where(F.size("claims") > 0).join(titles, "event")
    return some.select("event", title.alias("title"), "claims", "dropped", rule.alias("rule"))
