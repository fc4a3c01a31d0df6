"""Scores of what was found against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gazetteer
from ..session import spread, written


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The value at place floor(n / 2) of each group's sorted values, from counts of equal values: groups aren't collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    up_to = F.sum("__n").over(w.orderBy(value))
    middle = F.floor(F.sum("__n").over(w) / 2)
    reached = counts.withColumn("__up", up_to).withColumn("__mid", middle).where(F.col("__up") > F.col("__mid"))
    return reached.groupBy(*keys).agg(F.min(value).alias(name))


def majority(votes: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """The choice that over half of a key's votes agree on, where there is one."""
    counts = votes.groupBy(*keys, choice).agg(F.count("*").alias("votes"))
    k = F.sum("votes").over(Window.partitionBy(*keys))
    return counts.withColumn("__k", k).where(F.col("votes") >= F.floor(F.col("__k") / 2) + 1).select(*keys, choice, "votes")


def best_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, score: Column, least: float, share: float = 0.0) -> DataFrame:
    """For each left row the right row of the best score (ties: the smaller id) of at least `least`.

    Rows without a shared token can't score, so candidates meet in an inverted index instead of a cross join. score is an
    expression over shared, left_size and right_size. Where a score of `least` needs a share of the left tokens, only so many of the rarest ones
    must meet that one of them is shared, so frequent tokens, which very many rows have, are left out.
    """
    hashed = F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))  # made once, and narrower than words
    a = written(spread(left).select(left_id, hashed.alias("l_tokens"), F.size(tokens).alias("left_size")), "match-left")
    b = written(spread(right).select(right_id, hashed.alias("r_tokens"), F.size(tokens).alias("right_size")), "match-right")
    own = a.select(left_id, F.explode("l_tokens").alias("t"), F.size("l_tokens").alias("n"))
    theirs = b.select(right_id, F.explode("r_tokens").alias("t"))
    df = theirs.join(own.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")))
    ranked = own.join(df, "t", "left").groupBy(left_id, "n").agg(rarest.alias("o"))
    prefix = ranked.select(left_id, F.explode(F.slice("o", F.lit(1), F.col("n") - F.greatest(F.ceil(F.col("n") * share), F.lit(1)).cast("int") + 1)).alias("p")).select(left_id, F.col("p.t").alias("t"))
    pairs = prefix.join(theirs, "t").select(left_id, right_id).distinct()
    met = pairs.join(a, left_id).join(b, right_id).withColumn("shared", F.size(F.array_intersect("l_tokens", "r_tokens")).cast("bigint"))
    scored = met.withColumn("score", score).where(F.col("score") >= least)
    return scored.groupBy(left_id).agg(F.min_by(F.struct(right_id, "score"), F.struct(-F.col("score"), right_id)).alias("m")).select(left_id, f"m.{right_id}", "m.score")


def coverage(takeaways: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Takeaways, how many of them were matched, and the share in percent, in one row."""
    there = takeaways.select(key).join(matches.select(key, F.lit(True).alias("hit")), key, "left")
    return there.agg(F.count("*").alias("takeaways"), F.count("hit").alias("matched"), F.round(F.try_divide(F.count("hit") * 100.0, F.count("*")), 2).alias("coverage_pct"))


def keyword_matches(takeaways: DataFrame, claims: DataFrame) -> DataFrame:
    """Of takeaways (takeaway, places, acts) and claims (claim, places, acts) the best claim of each takeaway that reaches the match score
    (ties: the smaller claim): takeaway, claim, score. A match shares a place, so they meet over places, regions with their towns."""
    t = takeaways.select("takeaway", gazetteer.expanded(F.col("places")).alias("t_places"), F.col("acts").alias("t_acts"))
    c = claims.select("claim", F.col("places").alias("c_places"), F.col("acts").alias("c_acts"))
    best_of = F.struct("c_places", "c_acts")
    # claims with one signature score alike: the first of them stands for all
    c = c.groupBy("c_places", "c_acts").agg(F.min("claim").alias("claim")).select("claim", best_of.alias("sig"), F.explode("c_places").alias("place"))
    met = t.select("takeaway", "t_places", "t_acts", F.explode("t_places").alias("place")).join(c, "place").drop("place").distinct()
    score = gazetteer.match_score(F.col("t_places"), F.col("sig.c_places"), F.col("t_acts"), F.col("sig.c_acts"))
    scored = met.select("takeaway", "claim", F.round(score, 4).alias("score")).where(F.col("score") >= gazetteer.MATCH)
    return scored.groupBy("takeaway").agg(F.min_by(F.struct("claim", "score"), F.struct(-F.col("score"), "claim")).alias("m")).select("takeaway", "m.claim", "m.score")


def divergences(takeaways: DataFrame, claims: DataFrame, matches: DataFrame) -> DataFrame:
    """kind, takeaway, claim, score (two places), text (of the claim, 200 characters) and hedging: a row for each takeaway that can be matched, with its claim (agreement) or
    without (isw_only), and for each claim with a place or an act that no takeaway matched (ours_only).

    takeaways has takeaway, places, acts; claims has claim, places, acts, t (text), hedging; matches is keyword_matches() of both.
    """
    named = lambda df: df.where((F.size("places") > 0) | (F.size("acts") > 0))
    said = claims.select("claim", F.substring("t", 1, 200).alias("text"))
    found = named(takeaways).select("takeaway").join(matches, "takeaway", "left").join(said, "claim", "left")
    kind = F.when(F.col("claim").isNull(), "isw_only").otherwise("agreement")
    theirs = found.select(kind.alias("kind"), "takeaway", "claim", F.round("score", 2).alias("score"), "text", F.lit(None).cast("string").alias("hedging"))
    left = named(claims).join(matches.select("claim").distinct(), "claim", "left_anti")
    none = {c: F.lit(None).cast(dict(theirs.dtypes)[c]).alias(c) for c in ("takeaway", "score")}
    return theirs.unionByName(left.select(F.lit("ours_only").alias("kind"), none["takeaway"], "claim", none["score"], F.substring("t", 1, 200).alias("text"), "hedging"))


def digest_score(takeaways: DataFrame, claims: DataFrame, matches: DataFrame, published: Column) -> DataFrame:
    """One row on how a digest's claims (claim, places, acts, docs, hedging, earliest) cover a report's takeaways: takeaways that can be
    matched, matched ones, coverage_pct, thin_rate (claims of one document that are only claimed), lead_hours (the upper median of how
    long before publication evidence came), ours_only."""
    matchable = takeaways.where((F.size("places") > 0) | (F.size("acts") > 0))
    hit = matches.join(claims.select("claim", "earliest"), "claim")
    hours = (F.unix_micros(published.cast("timestamp")) - F.unix_micros(F.col("earliest").cast("timestamp"))) / 3.6e9
    lead = upper_median(hit.select(F.lit(1).alias("one"), hours.alias("hours")), ["one"], "hours", "lead_hours").select(F.round("lead_hours", 1).alias("lead_hours"))
    thin = F.count_if((F.col("docs") < 2) & F.col("hedging").isin("claimed", "unverified"))
    of_claims = claims.agg(F.round(F.coalesce(F.try_divide(thin, F.count("*")), F.lit(0.0)), 4).alias("thin_rate"))
    named = claims.where((F.size("places") > 0) | (F.size("acts") > 0))
    ours = named.join(matches.select("claim").distinct(), "claim", "left_anti").agg(F.count("*").alias("ours_only"))
    counts = matchable.join(matches.select("takeaway", F.lit(1).alias("hit")), "takeaway", "left").agg(F.count("*").alias("takeaways"), F.count("hit").alias("matched"))
    pct = F.round(F.try_divide(F.col("matched") * 100.0, F.col("takeaways")), 1).cast("double").alias("coverage_pct")
    one = F.lit(1).alias("one")
    # each side is one row
    return counts.select("*", pct, one).join(of_claims.select("*", one), "one").join(lead.select("*", one), "one", "left").join(ours.select("*", one), "one").drop("one")
