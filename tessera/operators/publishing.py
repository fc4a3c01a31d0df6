"""From extraction to publication: results of a map step, finalised events, refusals to overwrite, answers, screening, ownership, billing, run views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEDGING_LADDER

#: The classes that events' claims take, from the strongest on; groups that are only assessed say nothing about facts.
FACT_LADDER = ("confirmed", "claimed", "unverified", "unknown")

#: Claims that one document gives at most, and characters of a quote.
CLAIMS, QUOTE = 3, 300
RESULTS = (
    "results array<struct<docId: bigint, claims: array<struct<text_en: string, claim_type: string, hedging: string, quote_orig: string, entities: array<struct<name: string, kind: string, role: string>>>>>>"
)
#: A new digest of fewer than this share of the old one's events is refused.
LEAST_SHARE = 0.5
#: Providers and states whose answers aren't analyses, and units of the others.
DEGRADED, FREE_STATES = ("stub", "budget"), ("limit", "error")
UNITS_CACHED, UNITS_STANDARD, UNITS_DEEP = 0, 1, 3
#: How far each event takes a run; done and failed are the end.
PHASES = {"run.created": 0, "run.authorized": 0, "retrieval.lexical_partial": 1, "retrieval.completed": 2, "answer.started": 3, "run.completed": 4, "run.failed": 4}
PHASE_NAMES = ("starting", "retrieving", "selecting", "answering", "done")


def map_results(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """doc and claims of answers (batch, place, raw: JSON) to the documents sent (batch, doc).

    Documents that weren't sent are dropped, of repeated ones the first entry stays. Of a document CLAIMS claims with a text stay at most;
    quotes are cut, unknown kinds and hedgings fall back, entities need a name. An empty list is an answer: nothing relevant.
    """
    entries = answers.select("batch", F.posexplode(F.from_json("raw", RESULTS).getField("results")).alias("i", "r")).select("batch", "i", F.col("r.docId").alias("doc"), F.col("r.claims").alias("claims"))
    first = entries.groupBy("batch", "doc").agg(F.min_by("claims", "i").alias("claims"))
    own = first.join(sent.select("batch", "doc").distinct(), ["batch", "doc"], "left_semi")

    def clean(c: Column) -> Column:
        named = F.filter(c.getField("entities"), lambda e: e.getField("name").isNotNull() & (F.trim(e.getField("name")) != ""))
        kind, hedging = c.getField("claim_type"), c.getField("hedging")
        return F.struct(
            c.getField("text_en").alias("text"),
            F.when(kind.isin("factual", "assessment"), kind).otherwise("factual").alias("claim_type"),
            F.when(hedging.isin(*HEDGING_LADDER), hedging).otherwise("unknown").alias("hedging"),
            F.substring(c.getField("quote_orig"), 1, QUOTE).alias("quote"),
            F.coalesce(named, F.array().cast(named_type)).alias("entities"),
        )

    named_type = "array<struct<name: string, kind: string, role: string>>"
    some = F.filter(F.coalesce("claims", F.array().cast("array<struct<text_en: string, claim_type: string, hedging: string, quote_orig: string, entities: array<struct<name: string, kind: string, role: string>>>>")), lambda c: F.trim(F.coalesce(c.getField("text_en"), F.lit(""))) != "")
    return own.select("batch", "doc", F.transform(F.slice(some, 1, CLAIMS), clean).alias("claims"))


def wrong_entries(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """Per batch: entries for documents that weren't sent, and repeated entries."""
    entries = answers.select("batch", F.explode(F.from_json("raw", RESULTS).getField("results")).alias("r")).select("batch", F.col("r.docId").alias("doc"))
    marked = entries.groupBy("batch", "doc").agg(F.count("*").alias("n")).join(sent.select("batch", "doc").distinct().withColumn("there", F.lit(1)), ["batch", "doc"], "left")
    return marked.groupBy("batch").agg(F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.coalesce(F.sum(F.when(F.col("there").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated"))


def finalised(claims: DataFrame, groups: DataFrame, allegation: Column) -> DataFrame:
    """Of claims (event, claim, text, group: one row for each group it cites) with what their groups (group, claim_type, hedging, promoted, docs:
    array) say: event, claim, text, claim_type, hedging, docs. Where a claim is an allegation against a person (a column of the joined rows),
    corroboration alone doesn't confirm it."""
    ladder = F.array(*[F.lit(h) for h in FACT_LADDER])
    rung = lambda h: F.array_position(ladder, h)
    native = F.when(F.col("promoted"), F.lit("claimed")).otherwise(F.col("hedging"))
    found = (
        claims.join(groups, "group")
        .groupBy("event", "claim", "text")
        .agg(
            F.bool_and(F.col("claim_type") == "assessment").alias("__all"),
            F.min(F.nullif(rung(F.col("hedging")), F.lit(0))).alias("__h"),
            F.min(F.nullif(rung(native), F.lit(0))).alias("__n"),
            F.bool_or(allegation).alias("__bad"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"),
        )
    )
    name = lambda c: F.coalesce(F.get(ladder, F.col(c).cast("int") - 1), F.lit("unknown"))
    hedging = F.when(F.col("__all"), "assessed").when((name("__h") == "confirmed") & F.col("__bad"), name("__n")).otherwise(name("__h"))
    return found.select("event", "claim", F.substring("text", 1, 200).alias("text"), F.when(F.col("__all"), "assessment").otherwise("factual").alias("claim_type"), hedging.alias("hedging"), "docs")


def swapped(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Of digests (key, events) what is kept of old and new ones, with why: new, refused_empty or refused_thin (the old one stays)."""
    both = old.select(key, F.col("events").alias("__old")).join(new.select(key, F.col("events").alias("__new")), key, "full_outer")
    why = (
        F.when(F.col("__new").isNull(), "kept")
        .when((F.col("__new") == 0) & (F.coalesce("__old", F.lit(0)) > 0), "refused_empty")
        .when(F.col("__new") < LEAST_SHARE * F.coalesce("__old", F.lit(0)), "refused_thin")
        .otherwise("written")
    )
    return both.select(key, F.when(why == "written", F.col("__new")).otherwise(F.col("__old")).alias("events"), why.alias("decision"))


def answer(claims: DataFrame, question: str, order: list[Column], most: int = 6) -> DataFrame:
    """question, answer and cited: the best claims (claim, text) word for word, each with its mark."""
    w = Window.partitionBy(question).orderBy(*order)
    top = claims.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most)
    lines = F.array_sort(F.collect_list(F.struct("__i", "claim", "text")))
    mark = lambda x: F.concat(F.lit("• "), x.getField("text"), F.lit(" [c"), x.getField("claim").cast("string"), F.lit("]"))
    found = top.groupBy(question).agg(lines.alias("__l"))
    return found.select(question, F.concat(F.lit("Top matching evidence:\n"), F.array_join(F.transform("__l", mark), "\n")).alias("answer"), F.transform("__l", lambda x: x.getField("claim")).alias("cited"))


def evidence_line(claim: Column, theater: Column, track: Column, day: Column, hedging: Column, confidence: Column, entities: Column, text: Column) -> Column:
    """A claim with what it rests on, in one line."""
    reliability = F.coalesce(F.format_string("%.2f", confidence), F.lit("?"))
    return F.concat(
        F.lit("[c"), claim.cast("string"), F.lit("] ("), theater, F.lit("/"), F.coalesce(track, F.lit("-")), F.lit(", "), F.coalesce(day.cast("string"), F.lit("undated")), F.lit(", "), hedging,
        F.lit(", reliability "), F.when(confidence.isNull(), "?").otherwise(reliability), F.lit(", entities: "), F.array_join(F.slice(entities, 1, 4), ", "), F.lit(") "), text,
    )


def screened(results: Column) -> Column:
    """What a screening's results (array of match, topics, id, score, caption) say: only an accepted match asserts anything; the best rejected one is told
    as rejected."""
    accepted = F.get(F.filter(results, lambda r: F.coalesce(r.getField("match"), F.lit(False))), 0)
    hit = accepted.isNotNull()
    return F.struct(
        hit.alias("matched"),
        F.coalesce(F.array_contains(accepted.getField("topics"), "sanction"), F.lit(False)).alias("sanctioned"),
        F.when(hit, accepted.getField("id")).alias("id"),
        F.when(hit, accepted.getField("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(~hit, F.get(results, 0).getField("caption")).alias("rejected"),
    )


def ownership_edges(links: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (owner, owned, source) to add to the known ones: not of the stub, no loops, each once, none that is there."""
    real = links.where((F.col("source") != "stub") & (F.col("owner") != F.col("owned"))).select("owner", "owned", "source").distinct()
    return real.join(known.select("owner", "owned"), ["owner", "owned"], "left_anti")


def units(state: Column, provider: Column, cache: Column, replayed: Column, mode: Column) -> Column:
    """What a run costs: nothing for replays, failures and degraded answers."""
    free = F.coalesce(replayed, F.lit(False)) | state.isin(*FREE_STATES) | provider.isin(*DEGRADED)
    return F.when(F.coalesce(replayed, F.lit(False)), 0).when(cache == "exact", UNITS_CACHED).when(free, 0).when(mode == "deep", UNITS_DEEP).otherwise(UNITS_STANDARD)


def billable(units: Column, mode: Column, at: Column, cutover: Column) -> Column:
    """Whether a run may be invoiced: enforced, after a cutover that is set, and not free."""
    return (mode == "enforce") & F.coalesce(at >= cutover, F.lit(False)) & (units > 0)


def run_views(events: DataFrame, key: str) -> DataFrame:
    """key, last_seq and phase of runs from their events (seq, event): phases only go on, and nothing counts after the end but the number."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("event"))
    end = F.min(F.when(F.col("event").isin("run.completed", "run.failed"), F.struct("seq", "event")))
    found = events.groupBy(key).agg(F.max("seq").alias("last_seq"), F.coalesce(F.max(rank), F.lit(0)).alias("__r"), end.alias("__e"))
    phase = F.when(F.col("__e.event") == "run.failed", "failed").otherwise(F.get(F.array(*[F.lit(p) for p in PHASE_NAMES]), F.col("__r")))
    return found.select(key, "last_seq", phase.alias("phase"))


def compacted(turns: DataFrame, key: str, question: int = 200, budget: int = 1200) -> DataFrame:
    """key and history: a line for each turn (seq, question, state, cited, answer), and the last turn's answer."""
    t = F.array_sort(F.collect_list(F.struct("seq", "question", "state", "cited", "answer")))
    grouped = turns.groupBy(key).agg(t.alias("__t"))

    def line(x: Column) -> Column:
        cited = F.slice(x.getField("cited"), 1, 20)
        tail = F.when(F.size(cited) > 0, F.concat(F.lit(" [cited: "), F.array_join(F.transform(cited, lambda c: c.cast("string")), ","), F.lit("]"))).otherwise("")
        return F.concat(F.lit("T"), x.getField("seq").cast("string"), F.lit(": Q: "), F.substring(x.getField("question"), 1, question), F.lit(" → "), x.getField("state"), tail)

    last = F.element_at("__t", -1)
    said = F.when(last.getField("answer") != "", F.concat(F.lit("\nT"), last.getField("seq").cast("string"), F.lit(" answer: "), F.substring(last.getField("answer"), 1, budget))).otherwise("")
    return grouped.select(key, F.concat(F.array_join(F.transform("__t", line), "\n"), F.coalesce(said, F.lit(""))).alias("history"))
