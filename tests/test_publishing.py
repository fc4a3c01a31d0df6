"""Steps from extraction to publication, recovery of incremental reads, vectors and digests."""

import json
import math
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions import days, gazetteer
from tessera.operators import digests, embeddings, entities, keyed, near_duplicates, publishing, reduction, selection
from tessera.sources import adapters
from tessera.sources import raw_documents as sources
from tessera.streaming import incremental, recovery


def claim(text="It happened.", **over):
    return {"text_en": text, "claim_type": "factual", "hedging": "claimed", "quote_orig": "q", "entities": []} | over


def test_map_results(spark):
    entries = [
        {"docId": 1, "claims": [claim(), claim("  "), claim(), claim(), claim()]},
        {"docId": 1, "claims": []},
        {"docId": 999, "claims": [claim()]},
        {"docId": 2, "claims": []},
        {"docId": 3, "claims": [claim(quote_orig="и" * 500, hedging="definitely-true", claim_type="vibes", entities=[{"name": "Court", "kind": "agency", "role": "x"}, {"name": "", "kind": "person", "role": "y"}, {"kind": "person"}])]},
    ]
    answers = spark.createDataFrame([("b", json.dumps({"results": entries})), ("c", "not json")], "batch string, raw string")
    sent = spark.createDataFrame([("b", d) for d in (1, 2, 3, 4)] + [("c", 1)], "batch string, doc bigint")
    found = {r.doc: r.claims for r in publishing.map_results(answers, sent).collect()}
    assert {d: len(c) for d, c in found.items()} == {1: 3, 2: 0, 3: 1}
    (c,) = found[3]
    assert (c.claim_type, c.hedging, len(c.quote), [e.name for e in c.entities]) == ("factual", "unknown", 300, ["Court"])
    assert [tuple(r) for r in publishing.wrong_entries(answers, sent).collect()] == [("b", 1, 1)]


def test_independent_sources(spark):
    cases = [
        ([], 0),
        ([(1, None)], 0),
        ([(1, "a"), (2, "a")], 1),
        ([(1, "a"), (2, "b")], 2),
        ([(1, "a"), (1, "b")], 1),  # one text in two places
        ([(1, "a"), (2, "b"), (3, "b"), (3, "a")], 1),
        ([(1, "a"), (2, "b"), (3, "c"), (3, "a"), (4, None)], 2),
    ]
    df = spark.createDataFrame(cases, "links array<struct<document: bigint, domain: string>>, n int")
    assert all(r.n == r.found for r in df.select("n", reduction.independent(F.col("links")).alias("found")).collect())


def test_swaps_and_state(spark):
    old, new = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("e", 0)], "k string, events int"), spark.createDataFrame([("a", 0), ("b", 4), ("c", 5), ("d", 1), ("e", 0)], "k string, events int")
    assert {r.k: (r.events, r.decision) for r in publishing.swapped(old, new, "k").collect()} == {"a": (10, "refused_empty"), "b": (10, "refused_thin"), "c": (5, "written"), "d": (1, "written"), "e": (0, "written")}
    log = spark.createDataFrame([(1, 1, "x")], "k int, at int, v string")
    whole, latest = keyed.append_and_latest(log, spark.createDataFrame([(1, 2, "y"), (2, 1, "z")], log.schema), ["k"], ["at"])
    assert whole.count() == 3 and {(r.k, r.v) for r in latest.collect()} == {(1, "y"), (2, "z")}
    claims, bridge = spark.createDataFrame([(1,), (2,)], "claim int"), spark.createDataFrame([(1, 5)], "claim int, doc int")
    assert [r.claim for r in keyed.untraceable(claims, bridge, "claim").collect()] == [2]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    keyed.overwrite(df, f"{tmp_path}/t")
    keyed.overwrite(df.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    sources.write_lines(df, f"{tmp_path}/l")
    sources.write_lines(df, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 6


def test_windows_and_ladders(spark):
    assert [selection.ladder(n) for n in (10, 25, 40, 50, 100)] == [[10], [25], [40, 25], [50, 25], [100, 50, 25]]
    now = datetime(2026, 7, 1, 4, 0)
    assert days.next_fire(now, ["0 4 * * *", "*/15 * * * *", "30 19 * * *"]) == datetime(2026, 7, 1, 19, 30)
    assert days.next_fire(now, ["0 4 * * *"]) == datetime(2026, 7, 2, 4, 0)
    assert recovery.open_days(datetime(2026, 7, 1, 1)) == [(date(2026, 6, 30), False), (date(2026, 7, 1), False)]
    assert recovery.open_days(datetime(2026, 7, 1, 2))[0] == (date(2026, 6, 30), True)
    df = spark.createDataFrame([("2026-03-08 04:30:00",), ("2026-07-01 03:30:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [str(r.d) for r in df.select(days.shown_day(F.col("t")).alias("d")).collect()] == ["2026-03-07", "2026-06-30"]


def test_backfill_and_catch_up():
    b = recovery.backfill(10, 20, ["A", "b", "c"], 2)
    assert b.batches == 2 and not b.complete and b.refusal(10, 20, ["a", "B", "c"], 2) is None
    assert (b.refusal(10, 21, ["a", "b", "c"], 2), b.refusal(10, 20, ["b", "a", "c"], 2), b.refusal(10, 20, ["a", "b", "c"], 3)) == ("range", "roster", "batch size")
    b = b.after("x", pages=1).after("", pages=1, inserted=4)
    assert (b.batch, b.cursor, b.counts) == (1, "", {"pages": 2, "inserted": 4}) and b.after("").complete
    at = lambda d: datetime(2026, 7, d)
    assert recovery.parked(at(1), at(5), timedelta(days=3)) and not recovery.parked(None, at(5), timedelta(days=3))
    assert recovery.caught_up(at(1), at(1), at(4)) == at(4) and recovery.caught_up(at(2), at(1), at(4)) == at(2) and recovery.caught_up(at(5), at(5), at(4)) == at(5)


def test_episodes(spark):
    at = lambda h: datetime(2026, 7, 1) + timedelta(hours=h)
    runs = [("x", at(h), p) for h, p in enumerate([None, "empty", "empty", "empty", "empty", "stuck", None, None, "empty"])]
    df = spark.createDataFrame(runs, "k string, t timestamp, problem string")
    found = [r.fire for r in recovery.episodes(df, "k", "t", "problem", F.make_dt_interval(hours=F.lit(2))).orderBy("t").collect()]
    assert found == [None, "unhealthy", None, "unhealthy", None, "unhealthy", "recovery", None, "unhealthy"]


def stub_vector(text, size):
    """Number after number."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193 % 2**32
    out, a = [], h
    for _ in range(size):
        a = (a + 0x6D2B79F5) % 2**32
        t = (a ^ a >> 15) * (1 | a) % 2**32
        t = (t + (t ^ t >> 7) * (61 | t)) % 2**32 ^ t
        out.append(((t ^ t >> 14) % 2**32) / 2**32 * 2 - 1)
    n = math.sqrt(sum(x * x for x in out)) or 1
    return [x / n for x in out]


def test_stub_vectors(spark):
    df = spark.createDataFrame([("a",), ("Привіт 😀",), ("",), (None,), ("x" * 2500,)], "t string")
    for r in embedded_rows(df):
        assert (r.embedding is None) == (r.t is None)
        if r.t is not None:
            assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(r.embedding, stub_vector(r.t[:2000], 32), strict=True))
    assert embeddings.moved_on({"last": 9, "processed": 1}, 5, 3) == {"last": 9, "processed": 4}


def embedded_rows(df):
    return embeddings.embedded(df, "t", 32).collect()


def test_extractive_digest(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "ru", "Drone strike", "near Pokrovsk " + words, 0.9), (2, "ru", "Drone strike", "near Pokrovsk " + words + " more", None), (3, "ru", "Talks", "in Moscow", 0.2), (4, "ru", "Weather", "it rained", 0.2), (5, "ua", "Only", "one", 0.5)]
    df = spark.createDataFrame(docs, "id int, cell string, title string, content string, rel double")
    found = {(r.cell, r.place): (r.lead, r.docs, r.score) for r in digests.extractive(df, "cell", "id", "title", "content", "rel").collect()}
    assert found["ru", 1] == ("Drone strike", [1, 2], 5.2) and found["ru", 2] == ("Talks", [3], 2.7)
    assert found["ru", 3] == ("Weather", [4], 1.2) and found["ua", 1] == ("Only", [5], 1.5)  # few name places or actions, so all stay
    assert near_duplicates.BANDS == 16


def test_extractive_digest_reads_whole_texts(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(700))
    docs = [(1, "ru", "A", words("w") + " strike near Pokrovsk", 0.5), (2, "ru", "B", words("w") + " " + words("x"), 0.5), (3, "ru", "C", words("y"), 0.5), *((k, "ru", f"{k}", f"strike {words(chr(87 + k))}", 0.5) for k in range(10, 25))]
    df = spark.createDataFrame(docs, "id int, cell string, title string, content string, rel double")
    found = {tuple(r.docs): r.score for r in digests.extractive(df, "cell", "id", "title", "content", "rel").collect()}
    assert found[1,] == 3.5  # a place and an action at the end count, and a text that goes on otherwise is no copy
    assert len(found) == 12 and not {2, 3} & {k for d in found for k in d}  # 16 name an action, so those without any are left out


def test_match_scores(spark):
    rows = [("Pokrovsk drone", "Покровськ атака", 0.875), ("Pokrovsk", "pokrovsk and kupyansk and Kupiansk", 0.625), ("pokrovsk kupyansk strike", "kupyansk pokrovsk hit", 1.0), ("a strike", "an attack", 0.25), ("a", "b", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, score double")
    g = gazetteer
    s = g.match_score(g.toponyms(F.col("a")), g.toponyms(F.col("b")), g.actions(F.col("a")), g.actions(F.col("b")))
    assert all(r.score == r.found for r in df.select("score", s.alias("found")).collect())


def test_more_sources(spark, tmp_path):
    post = lambda i, t: {"id": str(i), "text": t, "createdAt": "x", "author": {"userName": "Ab"}}
    pages = [json.dumps({"tweets": [post(1, "a"), post(2, "")]}), json.dumps({"data": {"tweets": [post(1, "a"), post(3, "c")]}}), "junk"]
    found = sources.posts(spark.createDataFrame([(p,) for p in pages], "raw string"))
    assert {(r.id, r.author) for r in found.collect()} == {("1", "ab"), ("3", "ab")}
    assert sources.search_batches(["a", "b", "c"], 5, 2) == ["(from:a OR from:b) since_time:5", "(from:c) since_time:5"]
    html = '<p>x</p><div class="search-registry-entry-block box"><div class="registry-entry__header-mid__number"><a href="/epz/order?regNumber=77">№ 77</a></div><div class="registry-entry__body-value">Drones <b>now</b></div></div><div class="registry-entry__block"><i>none</i></div>'
    assert [tuple(r) for r in sources.tenders(spark.createDataFrame([(html,)], "html string"), "https://t.example").collect()] == [("№ 77", "https://t.example/epz/order?regNumber=77", "Drones now")]
    messages = spark.createDataFrame([("A", 5), ("a", 9), ("b", 1)], "channel string, message_id int")
    marks = spark.createDataFrame([("a", 6)], "channel string, high_mark int")
    assert sorted(tuple(r) for r in sources.since_marks(messages, marks).collect()) == [("a", 9), ("b", 1)]
    name = spark.range(1).select(sources.cached_name(F.lit("http://x")).alias("n")).head().n
    (tmp_path / name).write_text("<p>é</p>")
    assert [tuple(r) for r in sources.cached_pages(spark, str(tmp_path)).collect()] == [(name, "<p>é</p>")]


def test_adapters_as_a_data_source(spark):
    """Batches read all that an adapter has; a stream goes on after what it read, for each channel."""
    spark.dataSource.register(adapters.AdapterSource)
    rows = {"a": [[1, "one"], [2, "two"]], "b": [[5, "five"]]}
    options = {"adapter": "tessera.sources.adapters:Fixture", "fixture": json.dumps(rows)}
    found = spark.read.format("raw_documents").options(**options).load()
    assert found.columns == [f.name for f in sources.RAW_DOCUMENT]
    assert sorted((r.external_id, r.content) for r in found.collect()) == [("a/1", "one"), ("a/2", "two"), ("b/5", "five")]
    reader = adapters.AdapterStream(options)
    marks = reader.latestOffset()
    assert json.loads(marks["marks"]) == {"a": 2, "b": 5}
    (a, b) = reader.partitions({"marks": json.dumps({"a": 1})}, marks)
    assert [r[1] for part in (a, b) for r in reader.read(part)] == ["a/2", "b/5"]


def test_small_stream_parts(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("b", 2)], "k string, n int")
    assert [r.k for r in incremental.unknown_only(df, spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
    at = spark.createDataFrame([("2026-07-01 10:05:00", "x"), ("2026-07-01 10:55:00", "x"), ("2026-07-01 11:00:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert [r.n for r in incremental.tumbling_counts(at, "t", "k").orderBy("start").collect()] == [2, 1]
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
    writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    recovery.scheduled(writer, None).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    names = spark.createDataFrame([("k", "Ivan Petrov"), ("k", "I. Petrov"), ("k", "A. Petrov")], "key string, name string")
    assert [r.name for r in entities.representative_names(names).collect()] == ["A. Petrov"]


def test_gazetteer_lowers_a_text_once(spark):
    found = spark.createDataFrame([("Near POKROVSK and Lyman a strike",), (None,), ("",)], "t string").select(gazetteer.toponyms(F.col("t")).alias("p"), gazetteer.actions(F.col("t")).alias("a"))
    assert [(r.p, r.a) for r in found.collect()] == [(["pokrovsk", "lyman"], ["strike"]), ([], []), ([], [])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2  # one for places, one for actions
