"""The extractive digest of a cell: gather by caps, choose by a track's words, fold near copies, mix sources, rank clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gazetteer, scores
from ..session import spread, written
from . import keyed, near_duplicates

#: Documents of a gather, and of these of one adapter at most; characters that the words of a track are looked for in.
GATHERED, ADAPTER_SHARE, LEXICON_CHARS = 600, 0.4, 1500
#: A cell keeps documents without places or actions only where fewer than so many have some; clusters of a digest.
ENOUGH, CLUSTERS = 15, 12
#: Words (patterns) by which tracks choose documents.
ELITE = (
    r"(?iu)суд[аеу]?\b|арест|задержан|приговор|уголовн|обыск|СИЗО|прокурат|следственн|ФСБ|СКР?\b|взятк|коррупц|хищени|мошеннич|конфискац|национализац|изъяти|экстремист|иноагент|"
    r"госизмен|ОПГ|банд[ыуе]|криминальн|авторитет|олигарх|миллиардер|губернатор|мэр[аеу]?\b|министр|замминистр|отставк|назначен|уволен|скончался|погиб.{0,20}(бизнесмен|чиновник|депутат|генерал)|"
    r"court|arrest|detained|verdict|sentenc|criminal case|raid|prosecut|embezzl|briber|corruption|fraud|asset seizure|nationaliz|oligarch|billionaire|governor|dismissed|resign|"
    r"foreign agent|treason|gang|crime boss|mafia|cleric|ayatollah|IRGC|Majlis|Khamenei|succession|bonyad|crown prince|\bemir\b|royal decree|reshuffle|purge"
)
IRAN_MILITARY = (
    r"(?iu)strike|missile|drone|uav|air defense|air-defense|intercept|explosion|airstrike|shot down|ballistic|irgc|revolutionary guard|artesh|basij|quds force|centcom|"
    r"fifth fleet|idf|israeli|military exercise|drill|deployment|hezbollah|houthi|hamas|islamic jihad|militia|proxy|kataib|resistance|hormuz|strait|tanker|vessel|seiz|red sea|gulf of oman|"
    r"bab el-mandeb|shipping|naval|warship|frigate|natanz|fordow|isfahan|sabotage|enrichment site|سپاه|پهپاد|موشک|حمله|الحوثي|حزب الله|صاروخ|هجوم"
)
NUCLEAR = (
    r"(?iu)enrich|enrichment|centrifuge|IAEA|Fordow|Fordo|Natanz|Arak|Bushehr|Isfahan|breakout|\bHEU\b|uranium|reactor|inspector|safeguards|JCPOA|\bUF6\b|cascade|heavy water|"
    r"nuclear|warhead|weaponiz|proliferat|Grossi|20 percent|60 percent|weapons-grade|هسته|غنی|سانتریفیوژ|نطنز|فوردو|آژانس|اورانیوم|بوشهر"
)
TRACKS = {"elite_politics": ELITE, "iran_military": IRAN_MILITARY, "nuclear": NUCLEAR}


def whole(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def on_track(title: Column, content: Column, track: str) -> Column:
    """Whether a document's start has a word of the track; tracks without words take all."""
    return F.substring(whole(title, content), 1, LEXICON_CHARS).rlike(TRACKS[track]) if track in TRACKS else F.lit(True)


def gathered(docs: DataFrame, cell: list[str], adapter: str, reliability: str, published: str, key: str, most: int = GATHERED) -> DataFrame:
    """Of each cell the most reliable documents, then the latest; of one adapter at most a share. place tells their order."""
    order = [scores.reliability(F.col(reliability)).desc(), F.desc_nulls_last(published), F.col(key)]
    capped = keyed.top_per_group(docs, [*cell, adapter], order, -int(-most * ADAPTER_SHARE // 1), "__rn").drop("__rn")
    return keyed.top_per_group(capped, cell, order, most, "place")


def relevant(docs: DataFrame, cell: list[str], places: str, acts: str, enough: int = ENOUGH) -> DataFrame:
    """Documents that name a place or an action; a cell of fewer than `enough` of these keeps all."""
    some = (F.size(places) > 0) | (F.size(acts) > 0)
    n = F.count_if(some).over(Window.partitionBy(*cell))
    return docs.withColumn("__n", n).where(some | (F.col("__n") < enough)).drop("__n")


def extractive(docs: DataFrame, cell: str, key: str, title: str, content: str, reliability: str, track: str | None = None, similar: float = 0.5) -> DataFrame:
    """cell, place, lead, docs (of the cluster), score: of each cell the best clusters of near copies.

    A cluster counts by its documents, their reliability, and the places and actions that its first document names. Tracks with words of their own
    keep all documents. Places, actions and signatures are of whole texts; the lead is the start of a title.
    """
    rows = spread(docs).select(F.col(cell).alias("cell"), F.col(key).alias("key"), F.coalesce(title, content).alias("said"), scores.reliability(F.col(reliability)).alias("rel"), whole(F.col(title), F.col(content)).alias("text"))
    rows = rows.withColumns({"places": gazetteer.toponyms(F.col("text")), "acts": gazetteer.actions(F.col("text"))})
    if track is None:
        rows = relevant(rows, ["cell"], "places", "acts")
    rows = written(rows, "digest")  # read by the gate, for members and for leads
    found = near_duplicates.gate(rows.withColumn("day", F.lit("2000-01-01").cast("date")), "key", "text", "day", "cell", threshold=similar).select("key", "canonical")
    members = rows.join(found, "key")
    clusters = members.groupBy("cell", "canonical").agg(F.sort_array(F.collect_list("key")).alias("docs"), F.count("*").alias("n"), F.sum("rel").alias("rel"))
    first = rows.select("cell", F.col("key").alias("canonical"), "said", "places", "acts")
    score = F.round(F.col("n") + F.col("rel") + F.size("places") * 1.5 + F.size("acts") * 0.5, 6)
    ranked = keyed.top_per_group(clusters.join(first, ["cell", "canonical"]).withColumn("score", score), ["cell"], [F.desc("score"), F.col("canonical")], CLUSTERS, "place")
    return ranked.select(F.col("cell").alias(cell), "place", F.trim(F.substring("said", 1, 180)).alias("lead"), "docs", "score")
