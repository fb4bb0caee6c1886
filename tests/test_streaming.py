"""The streaming mirror, the feed reader and other sources."""

from pyspark.sql import functions as F

from newsloom.sources import readers
from newsloom.streaming import ingest


def test_items_once(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("s", "https://x.com/a?utm_source=1", "One", "2024-01-01 00:00:00"), ("s", "https://X.com/a/", "Two", "2024-01-01 01:00:00"), ("s", " ", "None", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "source_name string, link string, title string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(src)
    stream = ingest.entries(spark, src, "source_name string, link string, title string, at timestamp")
    q = ingest.write(ingest.new_items(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><link>https://x.com/1</link><title>T</title><pubDate>Mon, 06 Jul 2026 00:09:01 +0000</pubDate></item><item><link>l2</link></item></channel></rss>")
    rows = readers.feed(spark, str(tmp_path / "f.xml"), "src", limit=1).collect()
    assert [(r.source_name, r.link, r.published) for r in rows] == [("src", "https://x.com/1", "Mon, 06 Jul 2026 00:09:01 +0000")]


def test_evidence_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cache_version": "v", "game": "g", "analysis": {"site_name": "s", "positives": [{"point_fa": "p", "evidence_en": "e"}]}}')
    row = readers.evidence_cache(spark, str(tmp_path)).first()
    assert row.analysis.positives[0].evidence_en == "e" and row.refresh_meta is None
