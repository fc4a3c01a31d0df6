"""Functions on literal inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import names, scores, text, urls
from tessera.functions.windows import parse_window, without_phrase
from tessera.operators import freshness

TODAY = date(2026, 7, 15)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    "question, first, last",
    [
        ("since 2026-02-03 what", date(2026, 2, 3), TODAY),
        ("losses since March 5", date(2026, 3, 5), TODAY),
        ("since Feb 29", date(2024, 2, 29), TODAY),
        ("since August", date(2025, 8, 1), TODAY),
        ("strikes in february 2024", date(2024, 2, 1), date(2024, 2, 29)),
        ("the past 3 weeks", date(2026, 6, 24), TODAY),
        ("last month", date(2026, 6, 15), TODAY),
        ("this week", date(2026, 7, 13), TODAY),
        ("this month", date(2026, 7, 1), TODAY),
        ("yesterday", date(2026, 7, 14), date(2026, 7, 14)),
    ],
)
def test_windows(question, first, last):
    w = parse_window(question, TODAY)
    assert (w.first, w.last) == (first, last)
    assert w.phrase.lower() not in without_phrase(question, w).lower()


def test_windows_clamp_and_refuse():
    assert parse_window("last month", date(2026, 7, 31)).first == date(2026, 6, 30)
    assert parse_window("since 2026-02-31", TODAY) is None
    assert parse_window("what about drones", TODAY) is None


@pytest.mark.parametrize(
    "sentence, kind, cue",
    [
        ("Officials cannot independently verify the footage", "unverified", "cannot independently verify"),
        ("Geolocated footage shows gains", "confirmed", "Geolocated footage"),
        ("The move is likely a feint", "assessed", "likely"),
        ("A milblogger claimed an advance", "claimed", "claimed"),
        ("Forces advanced near the town", "unknown", None),
    ],
)
def test_hedging(spark, sentence, kind, cue):
    assert one(spark, text.hedging(F.col("s")), s=sentence) == kind
    assert one(spark, text.hedging_cue(F.col("s")), s=sentence) == cue


def test_languages(spark):
    for s, lang in (("the quick brown fox", "en"), ("Російські війська їхали", "uk"), ("Мы были объявлены выше", "ru"), ("سلام دنیا گزارش", "fa"), ("12", None)):
        assert one(spark, text.detect_language(F.col("s")), s=s) == lang


def test_shingles_and_tokens(spark):
    assert one(spark, text.word_shingles(F.col("s")), s="A b, c d! https://x.y/z a B c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, text.word_shingles(F.col("s")), s="Two words") == ["two words"]
    assert one(spark, text.word_shingles(F.col("s")), s=" !! ") == []
    assert sorted(one(spark, text.token_set(F.col("s")), s="The 8 tankers, in a port; 8 x")) == ["8", "port", "tankers"]


def test_urls(spark):
    clean = lambda u: one(spark, urls.clean_url(F.col("u")), u=u)
    assert clean("https://President dot Gov.ua/a?utm_source=x&b=1#f).") == "https://president.gov.ua/a?b=1"
    assert clean("https://a.b/?fbclid=1") == "https://a.b/"
    assert clean("ftp://x") is None
    who = lambda u: one(spark, urls.source(F.col("u")).getField("key"), u=u)
    assert who("https://t.me/s/Rybar/123") == "t.me/rybar" and who("https://twitter.com/@Some/status/1") == "x.com/some"
    assert who("https://www.tass.ru/x") == "tass.ru" and who("https://t.me/share") is None and who("https://understandingwar.org/a") is None
    kind = lambda u: one(spark, urls.source(F.col("u")).getField("platform"), u=u)
    assert [kind(u) for u in ("https://kremlin.ru/a", "https://rt.com", "https://bbc.com/x", "https://x.y")] == ["gov", "state_media", "independent_media", "other"]


def test_names(spark):
    key = lambda n: one(spark, names.key(F.col("n")), n=n)
    assert key("Андрей Воробьёв") == key("Андрей Воробьев") == key("Andrey Vorobyov") == "andrei vorobyov"
    assert key("Dr. Sergey Zelenskyy") == "sergei zelensky" and key("IRGC") == "islamic revolutionary guard corps"
    why = lambda n, k="person": one(spark, names.junk_reason(F.col("n"), F.lit(k), ["moscow"]), n=n)
    assert [why("Moscow"), why("Su-35"), why("unnamed official"), why("Two men"), why("local residents"), why("Stations in Crimea"), why("Houthi fighters"), why("Ali K")] == [
        "geography", "object", "unnamed", "counted", "collective", "descriptive", None, None,
    ]


def test_scores(spark):
    as_of, day = F.lit("2026-07-31").cast("date"), F.lit("2026-07-01").cast("date")
    assert abs(one(spark, scores.composite(F.lit(0.8), day, F.lit(1.0), as_of)) - 0.4) < 1e-9
    assert abs(one(spark, scores.composite(F.lit(None).cast("double"), F.lit(None).cast("date"), F.lit(None).cast("double"), as_of)) - 0.55 * 0.25 * 0.75) < 1e-9
    assert one(spark, scores.backoff_hours(F.lit(9))) == 48.0
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_periods_and_states(spark):
    start = lambda s: str(one(spark, freshness.period_start(F.col("s")), s=s))
    assert [start(s) for s in ("05.03.2026", "Май 2026", "март 2026", "2025", "31.02.2026", "soon")] == ["2026-03-05", "2026-05-01", "2026-03-01", "2025-01-01", "None", "None"]

    def status(http=200, size=1000, period=None, previous=None, baseline="ok", unchanged=None):
        c = lambda v, t: F.lit(v).cast(t)
        return one(spark, freshness.series_status(c(http, "int"), c(size, "int"), c(period, "string"), c(previous, "string"), F.lit(baseline), F.lit(30), c(unchanged, "int"), F.lit("2026-07-15").cast("date")))

    assert status(http=None) == "unreachable" and status(http=404) == "gone" and status(size=10) == "gone" and status(http=503) == "unreachable"
    assert status(period="2026") == "ok" and status(period="01.01.2026") == "stale" and status() == "ok"
    assert status(period="2019", previous="01.07.2026") == "ok" and status(baseline="classified") == "classified"
    assert status(period="n/a", previous="n/a", unchanged=61) == "stale"


def test_magnitudes_round_by_the_binary_value(spark):
    shown = lambda v: one(spark, text.magnitude(F.col("v")), v=v)
    assert [shown(v) for v in (198_500.0, 199_500.0, 2_500_000.0, 3_500_000.0)] == ["198K", "200K", "2M", "4M"]
    assert [shown(v) for v in (1.25e9, 1.75e9, 1.15e9, 1.05e9, 1.96e9, 9.99e9, 3e25)] == ["1.2B", "1.8B", "1.1B", "1.1B", "2.0B", "10.0B", "30000000000000000.0B"]
    assert shown(-300.0) == "-0K" and one(spark, text.magnitude(F.lit(None).cast("double"))) is None


def test_hedging_looks_for_parts_first(spark):
    said = ["It CANNOT independently verify it", "He has not yet confirmed", "unconfirmed reports", "Purportedly so", "Geolocated imagery", "footage posted today shows", "Visual confirmation", "satellite imagery shows", "It was confirmed"]
    said += ["ISW assesses", "ISW has previously noted", "It is Possibly so", "claiming this", "according to him", "reporting that", "He TOLD us", "sources indicated", "nothing", "", None]
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.hedging(F.col("s")).alias("got"), F.coalesce(*[F.when(F.col("s").rlike(f"(?i){p}"), F.lit(k)) for k, p in text.HEDGING_RULES], F.lit("unknown")).alias("want"))
    rows = df.collect()
    assert [r.got for r in rows] == [r.want for r in rows] and [r.s for r in rows if r.got == "unknown"] == ["nothing", "", None]
    assert len(text.HEDGING_PARTS) == len(text.HEDGING_RULES)
    assert text.hedging(F.col("s"))._jc.toString().lower().count("contains") >= len(text.HEDGING_RULES)


def test_ended_sentences_in_one_pass(spark):
    import time

    assert one(spark, text.ended_sentences(F.col("t")), t="A b. C..d.\nno end\n. e.\r\nf.g") == ["A b.", " C.", "d.", " e.", "f."]
    assert one(spark, text.ended_sentences(F.lit(None).cast("string"))) is None
    start = time.time()
    assert one(spark, F.size(text.ended_sentences(F.repeat(F.col("t"), 400_000))), t="x ") == 0
    assert time.time() - start < 20  # minutes, if it were tried anew at each character
