"""Readers of configuration, queues, overlays and images, the stream into a table, and operators against plain versions."""

import struct

import pytest
from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import blocks, html, udfs
from newsloom.operators import scoring
from newsloom.sources import readers, sinks
from newsloom.streaming import ingest

SITE = "https://www.site.example"


def test_atom_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title>T1</title><link rel="self" href="https://x.com/self"/><link href="https://x.com/1"/><summary>s</summary><updated>2026-07-06T00:09:01Z</updated></entry><entry><title>T2</title><link rel="alternate" href="https://x.com/2"/><published>p</published></entry></feed>')
    rows = readers.feed(spark, str(tmp_path / "a.xml"), "src").collect()
    assert [(r.link, r.title, r.summary, r.published, r.updated) for r in rows] == [("https://x.com/1", "T1", "s", None, "2026-07-06T00:09:01Z"), ("https://x.com/2", "T2", None, "p", None)]


def test_queue(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"reviews": [{"game": "A", "platform": "PC", "metacritic_url": "https://m.com/a", "review_urls": ["u1", "u2", "u3", "u4", " u5 "], "refresh_evidence": true}, {"game": " "}, 7]}')
    jobs = readers.queue_errors(readers.review_queue(spark, str(tmp_path / "q.json"))).orderBy("pos").collect()
    assert [r.errors for r in jobs] == [[], ["game", "platform", "no url", "few reviews"], ["game", "platform", "no url", "few reviews"]]
    assert jobs[0].review_urls[-1] == "u5" and jobs[0].refresh_evidence == "True"
    (tmp_path / "bad.json").write_text('{"reviews": 5}')
    with pytest.raises(ValueError):
        readers.review_queue(spark, str(tmp_path / "bad.json"))


def test_manual_evidence(spark, tmp_path):
    entry = '{"game": "A", "url": "https://x.com/r", "reviewed": true, "positives": [{"point_fa": "p", "evidence_en": "e"}, 3], "negatives": null}'
    (tmp_path / "list.json").write_text(f"[{entry}, 4]")
    (tmp_path / "map.json").write_text(f'{{"entries": [{entry}]}}')
    for name in ("list.json", "map.json"):
        points, status = readers.manual_evidence(spark, str(tmp_path / name))
        assert status == "loaded" and [(r.game, r.source_url, r.reviewed, r.section, r.pos, r.point_fa) for r in points.collect()] == [("A", "https://x.com/r", "True", "positives", 1, "p")]
    (tmp_path / "bad.json").write_text("{broken: [")
    (tmp_path / "odd.json").write_text('{"entries": 4}')
    assert [readers.manual_evidence(spark, str(tmp_path / n))[1] for n in ("bad.json", "odd.json", "none.json")] == ["invalid", "invalid", "missing"]


def test_localizations(spark, tmp_path):
    (tmp_path / "l.json").write_text(
        '{"localizations": {"Ghost Recon Wildlands": {"aliases": ["Tom Clancy’s Ghost Recon: Wildlands", "First"], "url": "https://site.example/a/"}, "First": {"aliases": "Ghost Recon Wildlands", "url": "https://www.site.example/b", "anchor": "go"},'
        ' "Off": {"url": "https://other.example/c"}, "Bad": {"url": "ftp://site.example/d"}, "None": 4}}'
    )
    pages = readers.localizations(spark, str(tmp_path / "l.json"), SITE)
    got = {r.key: (r.name, r.anchor) for r in pages.collect()}
    assert got["first"] == ("Ghost Recon Wildlands", "دانلود زیرنویس فارسی Ghost Recon Wildlands") and "off" not in got and "bad" not in got
    tags = spark.createDataFrame([(1, 0, "unknown"), (1, 1, "GHOST RECON™ Wildlands!"), (2, 0, "nothing")], "id int, pos int, tag string")
    assert [(r.id, r.url) for r in readers.localization_of(tags, pages).collect()] == [(1, "https://site.example/a/")]
    assert readers.localizations(spark, str(tmp_path / "none.json"), SITE).count() == 0


def test_cached_analyses(spark, tmp_path):
    good = '{"cache_version": "v2", "game": "Game", "platform": "PC", "requested_url": "https://X.com/r/?utm_source=1", "analysis": {"site_name": "s", "title": "t", "url": "u", "positives": [{"point_fa": "p", "evidence_en": "e"}], "negatives": [], "technical_notes": []}}'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text(good.replace("/r/", "/old/").replace('"v2"', '"v1"'))
    (tmp_path / "c.json").write_text("{broken")
    cache = readers.evidence_cache(spark, str(tmp_path))
    jobs = spark.createDataFrame([(" game ", "pc", "https://x.com/r"), ("game", "PC", "https://x.com/old"), ("game", "PS5", "https://x.com/r")], "game string, platform string, url string")
    found = readers.cached_analyses(cache, jobs, "v2")
    assert {(r.platform, r.url): r.cache_status for r in found.collect()} == {("pc", "https://x.com/r"): "hit", ("PC", "https://x.com/old"): "invalid", ("PS5", "https://x.com/r"): "miss"}
    assert [(r.section, r.pos, r.evidence_en) for r in readers.points_of(found, ["game"]).collect()] == [("positives", 1, "e")]


def test_settings():
    s = settings.read({"AUTO_TAGS_MAX": "7", "ITEM_MAX_RETRIES": "-1", "RECENT_LIMIT": "many", "EVIDENCE_CACHE": "off", "BASE_URL": " https://x "})
    assert (s.auto_tags_max, s.item_max_retries, s.recent_limit, s.evidence_cache, s.base_url) == (5, 0, 300, False, "https://x")
    assert settings.report(s)["base_url"] == "https://x"


def test_an_id_never_comes_twice(spark, tmp_path):
    schema = "source_name string, link string, title string, at string"
    target, state = str(tmp_path / "items"), str(tmp_path / "ck")
    days = [("2024-01-01", "a"), ("2024-03-01", "b"), ("2024-06-01", "a")]
    for n, (day, name) in enumerate(days):
        rows = [("s", f"https://x.com/{name}?utm_source={n}", f"Title {n}", f"{day} 00:00:00")]
        spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.entries(spark, str(tmp_path / "in"), "source_name string, link string, title string, at timestamp")
        ingest.append_new(stream, target, state).awaitTermination(120)
    assert sorted(r.title_en for r in spark.read.parquet(target).collect()) == ["Title 0", "Title 1"]


def test_image_headers(spark):
    vp8x = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 8 + (639).to_bytes(3, "little") + (359).to_bytes(3, "little")
    vp8l = b"RIFF" + b"\0" * 4 + b"WEBPVP8L" + b"\0" * 4 + b"\x2f" + ((99) | (49 << 14)).to_bytes(4, "little") + b"\0" * 5
    app = b"\xff\xe0" + struct.pack(">H", 6) + b"\xff\xc0\x00\x01"  # a segment whose content looks like a frame
    jpeg = b"\xff\xd8" + app + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 400) + b"\0" * 10
    cut = b"\xff\xd8\xff\xc0\x00\x11\x08"
    rows = [(1, vp8x), (2, vp8l), (3, jpeg), (4, cut), (5, b""), (6, None), (7, b"\xff\xd8\xff\xe0\x00\x01")]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in rows], "id int, data binary")
    got = {r.id: (r.d.width, r.d.height) for r in df.select("id", udfs.image_dimensions(F.col("data")).alias("d")).collect()}
    assert got == {1: (640, 360), 2: (100, 50), 3: (400, 300), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (0, 0)}


def test_page_parts(spark):
    page = "<title> A &amp;\n b </title><meta name='Description' content='one'><meta property=description content=two><meta itemprop=x><p>t &eacute;</p><script>if (a < b) {}</script><form>f</form>u<style>open"
    r = spark.createDataFrame([(page,), (None,)], "h string").select(html.page_title(F.col("h")).alias("t"), html.page_meta(F.col("h")).alias("m"), html.page_text(F.col("h")).alias("x")).collect()
    assert (r[0].t, r[0].m, r[0].x) == ("A & b", {"description": "one"}, "A & b t é u") and (r[1].t, r[1].m, r[1].x) == ("", {}, "")


def test_json_nodes(spark):
    df = spark.createDataFrame([(['{"a": {"b": [{"c": 1}]}, "d": 2}', "[3, {}]"],), ([],)], "d array<string>")
    got = [r.n for r in df.select(udfs.json_nodes(F.col("d")).alias("n")).collect()]
    assert got == [['{"a": {"b": [{"c": 1}]}, "d": 2}', '{"b": [{"c": 1}]}', '{"c": 1}', "{}"], []]


def test_image_and_link_blocks(spark):
    df = spark.createDataFrame([("https://x.com/a.png?x=1&y=2", 'a "b"', 7, 640), ("", "x", None, None)], "u string, alt string, id int, w int")
    got = [r.b for r in df.select(blocks.image(F.col("u"), F.col("alt"), F.col("id"), F.col("w")).alias("b")).collect()]
    assert '"id":7' in got[0] and 'src="https://x.com/a.png?x=1&amp;y=2"' in got[0] and "&quot;b&quot;" in got[0] and "max-width:640px" in got[0] and got[1] == ""
    card = blocks.scorecard(F.lit("x"), F.lit(8.5), F.array(F.struct(F.lit("جهان").alias("label"), F.lit(9.0).alias("score_10"))), "نظر")
    one = spark.range(1).select(card.alias("c")).first().c
    assert 'stroke-dashoffset="50.894"' in one and ">8.5<" in one and "width:90.0%" in one and ">9<" in one


@pytest.mark.parametrize("overall", [1.0, 5.5, 8.0, 10.0])
def test_balance_takes_the_most_strayed(spark, overall):
    import random

    rng, rows = random.Random(int(overall * 2)), []
    for g in range(25):
        for place in range(6):
            raw = min(10.0, max(1.0, overall + rng.choice([-1, -0.75, -0.4, 0, 0.4, 0.75, 1])))
            rows.append((g, place, f"c{place}", overall, raw, round(raw * 2) / 2, rng.choice([-1.0, 0.0, 0.5]), rng.randrange(4)))
    df = spark.createDataFrame(rows, "game int, place int, category string, overall_10 double, raw_10 double, score_10 double, direction double, evidence_count int")
    got = {(r.game, r.place): r.score_10 for r in scoring.balanced(df, ["game"]).collect()}
    for g in range(25):
        mine = {r[1]: r for r in rows if r[0] == g}
        units = {p: round(r[5] * 2) for p, r in mine.items()}
        while (short := round(overall * 2) * 6 - sum(units.values())) != 0:
            if short > 0:
                p = min((p for p in units if units[p] < 20), key=lambda p: (-(mine[p][4] * 2 - units[p]), -mine[p][6], -mine[p][7], units[p], p))
            else:
                p = min((p for p in units if units[p] > 2), key=lambda p: (mine[p][4] * 2 - units[p], mine[p][6], -mine[p][7], units[p], p))
            units[p] += 1 if short > 0 else -1
        assert {p: u / 2 for p, u in units.items()} == {p: got[g, p] for p in units}


def test_keyed_tables(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "key string, value string, seq int"
    one = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], schema)
    two = spark.createDataFrame([("a", "old", 1), ("b", "new", 1), ("c", "x", 1)], schema)
    sinks.upsert_table(one, root, ["key"], "seq")
    sinks.upsert_table(two, root, ["key"], "seq")
    assert sorted((r.key, r.value) for r in sinks.read_table(spark, root).collect()) == [("a", "2"), ("b", "new"), ("c", "x")]
    sinks.upsert_table(spark.createDataFrame([], schema), root, ["key"], "seq")
    assert sinks.read_table(spark, root).count() == 3 and len(list((tmp_path / "t").glob("v=*"))) == 2


def test_keyed_documents(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.write_keyed_json(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), path, "k")
    sinks.write_keyed_json(spark.createDataFrame([("a", 2)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.json(path).collect()) == [("a", 2), ("b", 1)]
    sinks.write_documents(spark.createDataFrame([("Game: One!", "text"), ("", "none")], "name string, body string"), str(tmp_path / "d"), "name", "body")
    assert {p.name for p in (tmp_path / "d").glob("name=*")} == {"name=game-one", "name=untitled"}


def test_media(spark):
    rows = spark.createDataFrame([("a.jpg", "jpg", "<b>x</b>", "t", True), ("b.png", "png", "", "t", True), ("c.gif", "gif", "x", "t", False)], "name string, ext string, alt string, fallback_alt string, accepted boolean")
    assert [tuple(r) for r in sinks.media_rows(rows).collect()] == [("a.jpg", "image/jpeg", "x"), ("b.png", "image/png", "t")]


def test_review_pages(spark):
    long = "word " * 100
    page = f'<meta property="og:title" content="T"><meta name="description" content="D"><p>menu</p><article><p>{long}</p></article>'
    rows = [("https://www.ign.com/r", 200, None, page), ("https://a.example/r", 404, None, "x"), ("https://a.example/r", 0, "timeout", None), ("https://a.example/r", 200, None, "<title>U</title><article>short</article> rest")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, url string, status int, error string, html string")
    got = readers.review_pages(df.drop("k")).collect()
    by = sorted(got, key=lambda r: (r.ok, r.status, r.title or ""))
    assert [r.error for r in by[:2]] == ["timeout", "HTTP 404"] and by[0].text is None and not by[1].ok
    assert (by[2].site_name, by[2].title, by[2].description, by[2].text) == ("IGN", "T", "D", long.strip())
    assert (by[3].title, by[3].score_text) == ("U", "U short rest")
