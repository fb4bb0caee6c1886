"""Known inputs and results of scalar, evidence and scoring operators, and edge rows."""

import difflib

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, html, scores, text, udfs, url
from newsloom.operators import evidence, ordered, scoring, similarity, state
from newsloom.plans import completion


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in columns.items()))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("HTTPS://WWW.Example.COM/review/game/?utm_source=test", "https://www.example.com/review/game"), ("https://www.example.com/review/game/", "https://www.example.com/review/game"), ("//x.com//a//b/", "https://x.com/a/b"), ("https://x.com", "https://x.com/")],
)
def test_cache_url(spark, given, wanted):
    assert one(spark, url.cache_url(F.col("u")), u=given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("HTTP://X.com/a/?b=2&a=1&UTM_Source=z#f", "http://x.com/a?a=1&b=2"), ("https://x.com", "https://x.com/"), ("https://x.com/?q=a+b&e=", "https://x.com/?e=&q=a+b"), (None, "/")],
)
def test_canonical(spark, given, wanted):
    assert one(spark, url.canonical(F.col("u")), u=given) == wanted


def test_slug(spark):
    assert one(spark, text.latin_slug(udfs.ascii_fold(F.col("s"))), s="Ghost of Yōtei Is Finally Coming to PC This Year") == "ghost-yotei-coming-pc"
    assert one(spark, text.latin_slug(udfs.ascii_fold(F.col("s"))), s="the of and") == ""


def test_match_key(spark):
    assert one(spark, udfs.match_key(F.col("s")), s="Ghost Recon: Wildlands™") == "ghost recon wildlands"


@pytest.mark.parametrize(("u", "name"), [("https://www.ign.com/x", "IGN"), ("https://www.gamesradar.com", "GamesRadar+"), ("https://example.com", None), ("https://notign.com", None)])
def test_known_sites(spark, u, name):
    assert one(spark, url.reputable_name(F.col("u")), u=u) == name


@pytest.mark.parametrize(
    ("quote", "section", "category", "sentiment"),
    [
        ("For what it's worth, this open world is a marvel.", "positives", "world_design", "positive"), ("It is worth the money.", "positives", "value", "positive"), ("There is a dip in performance.", "technical_notes", "technical", "negative"),
        ("Frame rate stability is among its triumphs.", "technical_notes", "technical", "positive"), ("The voice acting and soundtrack shine.", "positives", "audio", "positive"), ("Dubbing and sound design fall flat.", "negatives", "audio", "negative"), ("Nothing here.", "positives", None, None), ("The map", "other", None, None),
    ],
)
def test_classification(spark, quote, section, category, sentiment):
    c = one(spark, text.classify_evidence(F.col("q"), F.col("s")), q=quote, s=section)
    assert (c.category, c.sentiment) == (category, sentiment)


@pytest.mark.parametrize(("x", "floor", "near"), [(8.8, 8.5, 9.0), (7.75, 7.5, 8.0), (7.25, 7.0, 7.0), (0.2, 1.0, 1.0), (11.0, 10.0, 10.0), (2.25, 2.0, 2.0)])
def test_halves(spark, x, floor, near):
    assert one(spark, scores.floor_to_half(F.col("x")), x=x) == floor
    assert one(spark, scores.round_to_half(F.col("x")), x=x) == near


def test_dates(spark):
    assert one(spark, F.unix_seconds(dates.rfc822(F.col("s"))), s="Mon, 06 Jul 2026 00:09:01 +0000") == 1783296541
    assert one(spark, dates.published_ts(F.col("s"), F.timestamp_seconds(F.lit(5))), s="2026-07-06T00:09:01Z") == 5
    assert one(spark, dates.display_date(F.col("s")), s="Mon, 06 Jul 2026 00:09:01 +0000") == "6 جولای 2026"


def test_sequence_ratio(spark):
    pairs = [("abcd efgh", "abce fgh"), ("", "x"), ("a" * 300, "a" * 250 + "b"), (None, "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", udfs.sequence_ratio(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        assert r.x == (difflib.SequenceMatcher(a=r.a, b=r.b).ratio() if r.a and r.b else 0.0)


def test_similarity_join_is_exact(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    titles = [(k, " ".join(words[(k * s + j) % len(words)] for j in range(4 + k % 4))) for s in (1, 3) for k in range(30)]
    titles = [(i, t) for i, (_, t) in enumerate(titles)]
    df = spark.createDataFrame(titles, "id bigint, title_norm string")
    got = {(r.new_id, r.old_id) for r in similarity.similar_titles(df, df, 0.8).collect()}

    def score(a, b):
        x, y = set(a.split()), set(b.split())
        if min(len(a.split()), len(b.split())) < 5:
            return 0.0
        return 0.65 * difflib.SequenceMatcher(a=a, b=b).ratio() + 0.35 * len(x & y) / len(x | y)

    assert got == {(i, j) for i, a in titles for j, b in titles if i != j and score(a, b) >= 0.8}
    assert got


def test_greedy_caps_are_coupled(spark):
    rows = [("g", k, s, t) for k, (s, t) in enumerate([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("c", "z")])]
    df = spark.createDataFrame(rows, "game string, rank int, site string, topic string")
    kept = ordered.greedy_capped(df, ["game"], ["rank"], {"site": 1, "topic": {"x": 2, "y": 1}}, 10).collect()
    assert sorted(r["rank"] for r in kept) == [0, 2]  # the other topic has no limit entry and is left out


def test_retries(spark):
    items = spark.createDataFrame([("i", "pending", None, 0, None, None)], "id string, status string, wp_post_id bigint, retry_count int, next_retry_at timestamp, last_error string")
    for n, status in ((3, "pending"), (4, "failed")):
        log = spark.createDataFrame([("i", k, "failed", None, "x" * 600, None) for k in range(n)], "item_id string, seq bigint, event string, wp_post_id bigint, reason string, at timestamp")
        row = state.fold_events(items, log).first()
        assert (row.status, row.retry_count, len(row.last_error)) == (status, n, 500)


def test_insert_keeps_first(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "id string, pos int")
    assert sorted(map(tuple, state.insert_or_ignore(spark.createDataFrame([("b",)], "id string"), new, "pos").collect())) == [("a", 1)]


def test_balance(spark):
    rows = [("g", "p", 8.5, k, c, 0.0, 0, 0, 8.5, 8.5, "limited") for k, c in enumerate("abcdef")]
    card = spark.createDataFrame(rows, "game string, platform string, overall_10 double, place int, category string, direction double, evidence_count bigint, source_count bigint, raw_10 double, score_10 double, trend string")
    out = [r.score_10 for r in scoring.balanced(card.withColumn("score_10", F.col("score_10") - F.col("place") / 2), ["game", "platform"]).collect()]
    assert sum(out) / 6 == 8.5 and all(x * 2 == int(x * 2) for x in out)


def test_word_bounds(spark):
    for n, kept in ((7, 0), (8, 1), (26, 1), (27, 0)):
        assert one(spark, F.size(text.evidence_sentences(F.col("s"))), s=" ".join(["word"] * n) + ".") == kept


def test_article_errors(spark):
    good = "<p>" + "w " * 150 + ".</p><p>" + "w " * 150 + "</p><p>end.</p>"
    assert one(spark, F.size(html.article_errors(F.col("s"))), s=good) == 0
    assert one(spark, F.array_join(html.article_errors(F.col("s")), ","), s="<p>short <") .startswith("too short,too few paragraphs")


def test_refresh_counters(spark):
    rows = spark.createDataFrame([(1, 0, 0, "needs_review", 1), (2, 0, 100, "needs_review", 1)], "id int, old_rank int, new_rank int, new_status string, failed int")
    assert [(r.failed_after, r.manual_review) for r in evidence.after_refresh(rows).orderBy("id").collect()] == [(2, True), (0, False)]


def test_generation_falls_back(spark):
    rows = spark.createDataFrame([("a", "p", "instead")], "key string, prompt string, fallback string")
    assert completion.generate(rows).first().text == "instead"
    assert completion.generate(rows, lambda p: '{"text_fa": "made"}').first().text == "made"
    assert completion.generate(rows, lambda p: "no json").first().used_fallback
