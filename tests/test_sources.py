"""Sources: files of each kind become raw documents."""

import json

from tessera.sources import raw_documents as R

FEED = """<rss><channel><item><guid>g1</guid><link>http://x/1</link><title> One </title><description>&lt;p&gt;Body one&lt;/p&gt;</description><pubDate>Wed, 01 Jul 2026 10:00:00 +0000</pubDate></item>
<item><link>http://x/2</link><title>Two</title><pubDate>not a date</pubDate></item></channel></rss>"""
PAGE = """<div class="tgme_widget_message x" data-post="chan/1"><div class="tgme_widget_message_text">Привіт, їжаче мій</div><time datetime="2026-07-01T10:00:00+00:00"></time></div>
<div class="tgme_widget_message" data-post="chan/2"><time datetime="2026-07-01T11:00:00+00:00"></time></div>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    (tmp_path / "b.xml").write_text("not xml")
    found = {r.external_id: r for r in R.feeds(spark, str(tmp_path), "x").collect()}
    assert found["g1"].title == "One" and found["g1"].content == "Body one" and found["g1"].published_at.hour == 10
    assert found["http://x/2"].content == "Two" and found["http://x/2"].published_at is None
    assert [f.name for f in R.RAW_DOCUMENT] == R.feeds(spark, str(tmp_path), "x").columns


def test_channel_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (r,) = R.channel_pages(spark, str(tmp_path), "Chan", "ru").collect()
    assert (r.external_id, r.url, r.lang, r.country, r.source_key) == ("chan/1", "https://t.me/chan/1", "uk", "ua", "t.me/chan")


def test_json_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"articles": [{"url": "http://a", "title": "T", "seendate": "20260701T100000Z", "domain": "a", "language": "English"}, {"title": "no url"}]}))
    (r,) = R.article_list(spark, f"{tmp_path}/g.json").collect()
    assert (r.external_id, r.lang, r.published_at.hour) == ("http://a", "english", 10)
    rows = [{"reporterCode": 1, "partnerCode": 2, "primaryValue": 5.5, "period": "2024"}, {"reporterCode": 1, "partnerCode": 0, "primaryValue": 9}, {"reporterCode": 1, "partnerCode": 3, "primaryValue": "n/a"}]
    (tmp_path / "t.json").write_text(json.dumps({"data": rows}))
    assert [r.usd for r in R.trade_flows(spark, f"{tmp_path}/t.json").collect()] == [5.5]
    (tmp_path / "f.json").write_text('{"id": "1", "content": "c"}\n')
    assert R.fixtures(spark, f"{tmp_path}/f.json").head().content == "[stub] c"


def test_ingest_takes_documents_once(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"id": "1", "content": "c"}\n{"id": "2", "content": "d"}\n{"id": "2", "content": "d"}\n')
    batch = R.fixtures(spark, f"{tmp_path}/f.json")
    empty = R.ingest(spark.createDataFrame([], batch.schema).selectExpr("*", "'' AS content_hash"), batch)
    assert empty.count() == 2 and R.ingest(empty, batch).count() == 2
