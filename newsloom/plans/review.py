"""Queries of the review operators: evidence, audits, scores, facts, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scores, text, url
from newsloom.functions import vocabulary as V
from newsloom.operators import evidence, scoring
from newsloom.sources import readers

from .base import (
    Rows,
    literal,
    names,
    query,
    s_cache_url,
    s_class,
    s_clean_unescaped,
    s_collapse,
    table,
)

KEYS = ["game", "platform"]
#: game, platform, source_no, site_name, section, pos, point_fa, evidence_en
POINTS = Rows(
    "game string, platform string, source_no int, site_name string, section string, pos int, point_fa string, evidence_en string",
    [
        ("A", "PC", 1, "IGN", "positives", 1, "جهان باز بازی بسیار زنده است", "The open world is the best part of this adventure by far."),
        ("A", "PC", 1, "IGN", "positives", 2, "مبارزه و نبرد سریع و دقیق است", "Combat is fast, precise, and every boss asks for a new plan."),
        ("A", "PC", 1, "IGN", "negatives", 1, "داستان شخصیت پردازی ضعیفی دارد", "The story never finds a reason to care about its people."),
        ("A", "PC", 1, "IGN", "technical_notes", 1, "عملکرد فنی در شهرها افت می کند", "A dip in performance is common in the larger cities."),
        ("A", "PC", 2, "Kotaku", "positives", 1, "موسیقی و صداگذاری عالی است", "The soundtrack and voice acting carry many quiet scenes."),
        ("A", "PC", 2, "Kotaku", "negatives", 1, "پازل ها تکراری هستند", "Every puzzle repeats the same idea until it wears thin."),
        ("A", "PC", 2, "Kotaku", "technical_notes", 1, "فریم پایدار است", "Frame rate stability is the biggest triumph of this port."),
        ("A", "PC", 3, "Polygon", "positives", 1, "قیمت و محتوا منصفانه است", "It is worth the price for the sheer amount of content."),
        ("A", "PC", 3, "Polygon", "negatives", 1, "جهان باز بازی بسیار زنده است", "The open world is the best part of this adventure by far."),
        ("A", "PC", 3, "Polygon", "positives", 2, "تجربه‌ای جذاب و خوب و ناب", "For what it's worth, I liked it a lot and then some more."),
        ("B", "PS5", 1, "IGN", "positives", 1, "گرافیک و نورپردازی چشم نواز است", "The graphics and lighting are a marvel on this console."),
        ("B", "PS5", 2, "", "technical_notes", 1, "باگ های زیادی دارد بازی هنوز", "Technical notes here are about the user interface mostly."),
        ("C", "PC", 1, "VG247", "positives", 1, "خوب", "Nothing that any rule would know about is in here."),
    ],
)
_QUOTE = s_clean_unescaped("evidence_en")
_CAT, _SENT = s_class("q", "section")
CLASSED = f"(SELECT *, CASE WHEN sent IS NOT NULL THEN cat END AS category, CASE WHEN cat IS NOT NULL THEN sent END AS sentiment FROM (SELECT *, {_CAT} AS cat, {_SENT} AS sent FROM (SELECT *, {_QUOTE} AS q FROM {POINTS.sql()})))"


@query("t21_classified_evidence", f"SELECT game, platform, source_no, section, pos, category, sentiment FROM {CLASSED}")
def t21(spark, sf_dir):
    return evidence.classified(POINTS.df(spark)).select("game", "platform", "source_no", "section", "pos", "category", "sentiment")


_CATS = "list_sort(list_distinct(list(category) FILTER (category IS NOT NULL)))"


@query(
    "a1_quality_audit",
    f"""WITH a AS (SELECT game, platform, source_no, count(*) FILTER (section = 'positives') AS n_positives, count(*) FILTER (section = 'negatives') AS n_negatives, count(*) FILTER (section = 'technical_notes') AS n_technical_notes,
    count(*) AS verified_points, count(category) AS categorised_points, coalesce({_CATS}, CAST([] AS VARCHAR[])) AS cats FROM {CLASSED} GROUP BY ALL)
    SELECT game, platform, source_no, n_positives, n_negatives, n_technical_notes, verified_points, categorised_points, array_to_string(cats, ',') AS categories,
    CASE WHEN verified_points < 2 OR categorised_points = 0 THEN 'needs_review' ELSE 'acceptable' END AS status, list_extract([{names(V.COVERAGE_LABELS)}], CAST(least(len(cats), 3) + 1 AS INTEGER)) AS coverage,
    CAST(100 * verified_points + 20 * categorised_points + 25 * len(cats) AS BIGINT) AS quality_rank FROM a""",
)
def a1(spark, sf_dir):
    return evidence.audit(POINTS.df(spark), [*KEYS, "source_no"]).select(
        *KEYS, "source_no", *(f"n_{s}" for s in evidence.SECTIONS), "verified_points", "categorised_points", F.array_join("categories", ",").alias("categories"), "status", "coverage", "quality_rank"
    )


SOURCES = Rows(
    "game string, platform string, site_name string, status string, review_score_10 string, metascore_100 int",
    [("A", "PC", "x", "acceptable", "8.0", 88), ("A", "PC", "y", "needs_review", "9.5", 88), ("B", "PS5", "x", "acceptable", "8.5", None), ("B", "PS5", "y", "acceptable", "8.0", None), ("B", "PS5", "z", "needs_review", "9.0", None), ("C", "PC", "x", "needs_review", "7", None), ("D", "PC", "x", "acceptable", "12", 77)],
)
OVERALL = f"""(SELECT *, CASE WHEN coalesce(metacritic_10, average_10) IS NOT NULL THEN floor((least(greatest(coalesce(metacritic_10, average_10), 1.0), 10.0) + 1e-9) * 2) / 2 END AS overall_10 FROM (SELECT game, platform, round_even(max(metascore_100) / 10, 1) AS metacritic_10,
  round_even(avg(CASE WHEN status = 'acceptable' AND TRY_CAST(review_score_10 AS DOUBLE) BETWEEN 0 AND 10 THEN round_even(TRY_CAST(review_score_10 AS DOUBLE), 1) END), 2) AS average_10 FROM {SOURCES.sql()} GROUP BY ALL))"""


@query("a2_overall_score", f"SELECT game, platform, metacritic_10, average_10, overall_10 FROM {OVERALL}")
def a2(spark, sf_dir):
    return scoring.overall(SOURCES.df(spark), KEYS)


@query(
    "a2_overall_orders",
    """SELECT o_orderpriority AS game, o_orderstatus AS platform, round_even(avg(CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal BETWEEN 0 AND 10000 THEN round_even(CAST(c_acctbal AS INTEGER) / 1000, 1) END), 2) AS average_10
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def a2_orders(spark, sf_dir):
    """The same aggregation over a join of the larger tables."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        F.col("o_orderpriority").alias("game"), F.col("o_orderstatus").alias("platform"), F.when(F.col("c_mktsegment") != "BUILDING", "acceptable").otherwise("needs_review").alias("status"),
        (F.round("c_acctbal").cast("int") / 1000).alias("review_score_10"), F.lit(None).cast("int").alias("metascore_100"),
    )
    return scoring.overall(rows, KEYS).select("game", "platform", "average_10")


CARD = f"""(WITH g AS (SELECT game, platform, overall_10, unnest([{names(V.SCORECARD_CATEGORIES)}]) AS category FROM {OVERALL} WHERE overall_10 IS NOT NULL),
  s AS (SELECT game, platform, CASE category WHEN 'audio' THEN 'visuals' ELSE category END AS category, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS v, site_name FROM {CLASSED} WHERE category IS NOT NULL),
  a AS (SELECT game, platform, category, avg(CAST(v AS DOUBLE)) AS direction, count(*) AS evidence_count, count(DISTINCT nullif(site_name, '')) AS source_count FROM s GROUP BY ALL),
  j AS (SELECT g.*, coalesce(direction, 0.0) AS direction, coalesce(evidence_count, 0) AS evidence_count, coalesce(source_count, 0) AS source_count FROM g LEFT JOIN a USING (game, platform, category)),
  r AS (SELECT *, least(greatest(overall_10 + direction * CASE WHEN evidence_count >= 4 AND source_count >= 3 THEN 1.0 WHEN evidence_count >= 3 AND source_count >= 2 THEN 0.75 WHEN evidence_count >= 1 THEN 0.4 ELSE 0.0 END, 1.0), 10.0) AS raw_10 FROM j)
  SELECT *, round_even(raw_10 * 2, 0) / 2 AS score_10, CASE WHEN direction >= 0.35 THEN 'positive' WHEN direction <= -0.35 THEN 'negative' WHEN evidence_count > 0 THEN 'mixed' ELSE 'limited' END AS trend FROM r)"""


def card(spark):
    return scoring.scorecard(POINTS.df(spark), scoring.overall(SOURCES.df(spark), KEYS), KEYS)


@query("a4_category_scores", f"SELECT game, platform, category, round(direction, 9) AS direction, evidence_count, source_count, score_10, trend FROM {CARD}")
def a4(spark, sf_dir):
    return card(spark).select(*KEYS, "category", F.round("direction", 9).alias("direction"), "evidence_count", "source_count", "score_10", "trend")


_STEPS = f"""WITH c AS (SELECT *, CAST(list_position([{names(V.SCORECARD_CATEGORIES)}], category) AS INTEGER) AS place, CAST(round(score_10 * 2) AS INTEGER) AS unit FROM {CARD}),
  g AS (SELECT *, CAST(round_even(overall_10 * 2, 0) AS INTEGER) * 6 - CAST(sum(unit) OVER (PARTITION BY game, platform) AS INTEGER) AS gap FROM c),
  s AS (SELECT *, unnest(range(0, CAST(least(abs(gap), CASE WHEN gap > 0 THEN 20 - unit ELSE unit - 2 END) AS BIGINT))) AS step FROM g),
  t AS (SELECT *, unit + sign(gap) * step AS now FROM s),
  r AS (SELECT game, platform, place, row_number() OVER (PARTITION BY game, platform ORDER BY -sign(gap) * (raw_10 * 2 - now), -sign(gap) * direction, evidence_count DESC, now, place) AS turn, abs(gap) AS n FROM t),
  m AS (SELECT game, platform, place, count(*) AS moves FROM r WHERE turn <= n GROUP BY ALL)
  SELECT game, platform, category, CAST((unit + sign(gap) * coalesce(moves, 0)) / 2 AS DOUBLE) AS score_10 FROM g LEFT JOIN m USING (game, platform, place)"""


@query("a5_balanced_scorecard", _STEPS)
def a5(spark, sf_dir):
    return scoring.balanced(card(spark), KEYS).select(*KEYS, "category", "score_10")


@query("a5_scorecard_mean", f"SELECT game, platform, overall_10 AS mean_10 FROM {OVERALL} WHERE overall_10 IS NOT NULL")
def a5_mean(spark, sf_dir):
    """The balance's invariant: the mean of a game's six scores is its overall score."""
    return scoring.balanced(card(spark), KEYS).groupBy(*KEYS).agg(F.round(F.avg("score_10"), 6).alias("mean_10"))


@query("a10_trend_labels", f"SELECT game, platform, trend, string_agg(category, ',' ORDER BY category) AS categories FROM {CARD} GROUP BY ALL")
def a10(spark, sf_dir):
    return card(spark).groupBy(*KEYS, "trend").agg(F.array_join(F.sort_array(F.collect_list("category")), ",").alias("categories"))


@query("a8_coverage", f"""WITH s AS (SELECT game, list_distinct(list(site_name)) AS n FROM {POINTS.sql()} GROUP BY game)
    SELECT game, array_to_string(list_filter([{names(V.CORE_SITES)}], lambda x: list_contains(n, x)), ',') AS covered, array_to_string(list_filter([{names(V.CORE_SITES)}], lambda x: NOT list_contains(n, x)), ',') AS missing,
    array_to_string(list_sort(list_filter(n, lambda x: x <> '' AND x NOT IN ({names(V.CORE_SITES)}))), ',') AS others FROM s""")  # fmt: skip
def a8(spark, sf_dir):
    core = F.array(*(F.lit(x) for x in V.CORE_SITES))
    s = POINTS.df(spark).groupBy("game").agg(F.collect_set("site_name").alias("n"))
    return s.select("game", F.array_join(F.array_intersect(core, "n"), ",").alias("covered"), F.array_join(F.array_except(core, F.col("n")), ",").alias("missing"), F.array_join(F.sort_array(F.filter(F.array_except("n", core), lambda x: x != "")), ",").alias("others"))


@query("a9_score_spread", f"SELECT game, platform, CAST(count(s) AS BIGINT) AS n, round(max(s) - min(s), 6) AS spread, max(s) - min(s) >= 1.5 AS wide FROM (SELECT game, platform, TRY_CAST(review_score_10 AS DOUBLE) AS s FROM {SOURCES.sql()}) GROUP BY ALL HAVING count(s) >= 2")
def a9(spark, sf_dir):
    s = SOURCES.df(spark).withColumn("s", F.col("review_score_10").try_cast("double"))
    spread = F.max("s") - F.min("s")
    return s.groupBy(*KEYS).agg(F.count("s").alias("n"), F.round(spread, 6).alias("spread"), (spread >= 1.5).alias("wide")).filter("n >= 2")


@query("a12_label_shares", "SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS usable, CAST(count(*) - sum(quality) AS BIGINT) AS thin FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a12(spark, sf_dir):
    """Usable and thin rows of each source, over the labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("usable"), (F.count("*") - F.sum("quality")).alias("thin"))


# --- sentences and catalogs ---------------------------------------------------------------------

_SENT_SPLIT = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \\-–—]+|[ \\-–—]+$', '', 'g')), lambda s: s <> '' AND len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_''-]*')) BETWEEN 8 AND 26)"


@query(
    "r4_evidence_catalog",
    f"""WITH s AS (SELECT conv_id * 1000 + turn AS id, {_SENT_SPLIT.format(x=s_collapse("text"))} AS l FROM conversations),
    e AS (SELECT id, unnest(l) AS sentence, generate_subscripts(l, 1) AS i FROM s), f AS (SELECT id, sentence, i, row_number() OVER (PARTITION BY id, lower(sentence) ORDER BY i) AS r FROM e),
    n AS (SELECT id, sentence, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM f WHERE r = 1) SELECT id, printf('E%03d', k) AS evidence_id, sentence FROM n WHERE k <= 150""",
)
def r4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("").alias("title"), F.lit("").alias("description"), "text")
    return evidence.catalog(c, "id").select("id", "evidence_id", "sentence")


# --- claims, merges, overlays -------------------------------------------------------------------


def _sql_compatible(fa: str, en: str) -> str:
    from newsloom.functions.vocabulary import CLAIM_DOMAINS

    parts = [f"(NOT regexp_matches({fa}, {literal('|'.join(t))}) OR regexp_matches({en}, {literal('(?i)(?:' + '|'.join(p) + ')')}))" for t, p in CLAIM_DOMAINS]
    return f"({fa} <> '' AND " + " AND ".join(parts) + ")"


@query("t22_claims", f"SELECT game, platform, source_no, section, pos, {_sql_compatible('fa', 'en')} AS compatible FROM (SELECT *, {s_clean_unescaped('point_fa')} AS fa, lower({_QUOTE}) AS en FROM {POINTS.sql()})")
def t22(spark, sf_dir):
    return POINTS.df(spark).select("game", "platform", "source_no", "section", "pos", text.claim_compatible(F.col("point_fa"), F.col("evidence_en")).alias("compatible"))


@query(
    "f5_protocol_upgrade",
    f"""WITH p AS (SELECT game, platform, section, {s_clean_unescaped('point_fa')} AS fa, {_QUOTE} AS q FROM {POINTS.sql()}), c AS (SELECT *, fa <> '' AND q <> '' AND len(regexp_extract_all(q, '[\\w][\\w''-]*')) BETWEEN 8 AND 26 AND {_sql_compatible('fa', 'lower(q)')} AS clean FROM p),
    k AS (SELECT game, platform, lower(q) AS q, bool_and(clean) AS clean, count(DISTINCT section) AS n FROM c GROUP BY ALL) SELECT game, platform, bool_or(NOT clean OR n > 1) AS needs_upgrade FROM k GROUP BY ALL""",
)
def f5(spark, sf_dir):
    return evidence.needs_upgrade(POINTS.df(spark), KEYS)


CANDIDATES = Rows(POINTS.ddl, [("A", "PC", 1, "IGN", "positives", 1, "متن دیگر", "The OPEN world is the best part of this adventure by far."), ("A", "PC", 1, "IGN", "positives", 2, "تازه", "A new sentence that was not there before, truly."), ("B", "PS5", 1, "IGN", "negatives", 1, "تازه دوم", "Another new sentence that was not there before."), ("B", "PS5", 1, "IGN", "negatives", 2, "", "No claim")])


@query(
    "j10_merged_points",
    f"""WITH b AS (SELECT *, 0 AS f FROM {POINTS.sql()} WHERE source_no = 1 UNION ALL SELECT *, 1 FROM {CANDIDATES.sql()}), c AS (SELECT *, {s_clean_unescaped('point_fa')} AS fa, {_QUOTE} AS q FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY game, platform, section, lower(q) ORDER BY f, pos) AS r FROM c WHERE fa <> '' AND q <> ''), e AS (SELECT *, row_number() OVER (PARTITION BY game, platform, section ORDER BY f, pos) AS place FROM d WHERE r = 1)
    SELECT game, platform, section, CAST(place AS INTEGER) AS place, fa AS point_fa, q AS evidence_en FROM e WHERE place <= 6""",
)
def j10(spark, sf_dir):
    return evidence.merged(POINTS.df(spark).filter("source_no = 1"), CANDIDATES.df(spark), KEYS).select(*KEYS, "section", "place", "point_fa", "evidence_en")


MANUAL = Rows(
    "game string, platform string, source_url string, reviewed string, section string, pos int, point_fa string, evidence_en string",
    [("a", "", "https://X.com/r/?utm_source=1", "yes", "positives", 1, "م", "e1"), ("A", "pc", "https://x.com/r", "true", "negatives", 1, "م", "e2"), ("A", "PS5", "https://x.com/r", "1", "positives", 1, "م", "e3"), ("A", "PC", "https://x.com/r", "no", "positives", 1, "م", "e4"), ("A", "PC", "https://y.com/r", "on", "positives", 1, "م", "e5")],
)


@query("j7_manual_overlay", f"SELECT 'A' AS game, 'PC' AS platform, section, evidence_en FROM {MANUAL.sql()} WHERE lower(trim(reviewed)) IN ('1', 'true', 'yes', 'on') AND lower(game) = 'a' AND lower(platform) IN ('', 'pc') AND {s_cache_url('source_url')} = 'https://x.com/r'")
def j7(spark, sf_dir):
    sources = spark.createDataFrame([("A", "PC", "https://x.com/r", 1, "X")], "game string, platform string, cache_url string, source_no int, site_name string")
    return evidence.overlay(sources, MANUAL.df(spark).withColumn("cache_url", url.cache_url(F.col("source_url")))).select("game", "platform", "section", "evidence_en")


REFRESH = Rows("id int, old_rank int, new_rank int, new_status string, failed int", [(1, 100, 200, "acceptable", 1), (2, 100, 100, "needs_review", 0), (3, 100, 100, "needs_review", 1), (4, 0, 0, "needs_review", 5), (5, 300, 300, "acceptable", 1), (6, 0, 100, "needs_review", 1)])


@query(
    "st6_refresh",
    f"""WITH a AS (SELECT *, new_rank > old_rank AS accepted FROM {REFRESH.sql()}), b AS (SELECT *, CASE WHEN accepted THEN 0 WHEN new_status <> 'needs_review' THEN 1 ELSE least(failed, 99) + 1 END AS failed_after FROM a)
    SELECT id, accepted, CAST(failed_after AS INTEGER) AS failed_after, new_status = 'needs_review' AND NOT accepted AND failed_after >= 2 AS manual_review FROM b""",
)
def st6(spark, sf_dir):
    return evidence.after_refresh(REFRESH.df(spark)).select("id", "accepted", "failed_after", "manual_review")


CHOSEN = Rows("game string, section string, pos int, evidence_id string, point_fa string, evidence_en string", [("A", "positives", 1, "E001", "جهان باز است", "The open world is big"), ("A", "positives", 2, "E001", "تکرار", "The open world is big"), ("A", "negatives", 1, "E001", "باز", "The open world is big"), ("A", "negatives", 2, "E002", "کوتاه است", "It is short"), ("A", "positives", 3, "E003", "نبرد خوب", "No such thing here"), ("A", "technical_notes", 1, "E004", "باگ دارد", "A bug is here")])


_CHOSEN = f"(SELECT *, CASE section WHEN 'positives' THEN 1 WHEN 'negatives' THEN 2 ELSE 3 END AS s FROM {CHOSEN.sql()} WHERE {_sql_compatible(s_clean_unescaped('point_fa'), 'lower(' + s_clean_unescaped('evidence_en') + ')')})"


@query(
    "r8_selected_points",
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY game, evidence_id ORDER BY s, pos) AS i, row_number() OVER (PARTITION BY game, lower(evidence_en) ORDER BY s, pos) AS q FROM {_CHOSEN}),
    b AS (SELECT *, row_number() OVER (PARTITION BY game, section ORDER BY pos) AS k FROM a WHERE i = 1 AND q = 1) SELECT game, section, evidence_id FROM b WHERE k <= CASE section WHEN 'technical_notes' THEN 2 ELSE 3 END""",
)
def r8(spark, sf_dir):
    return evidence.select_catalog_points(CHOSEN.df(spark), ["game"], {"positives": 3, "negatives": 3, "technical_notes": 2}).select("game", "section", "evidence_id")


@query("a11_conflicts", f"SELECT game, lower({_QUOTE}) AS quote FROM {POINTS.sql()} GROUP BY ALL HAVING bool_or(section = 'positives') AND bool_or(section = 'negatives')")
def a11(spark, sf_dir):
    p = POINTS.df(spark).withColumn("quote", F.lower(text.clean_unescaped(F.col("evidence_en"))))
    found = p.groupBy("game", "quote").agg(F.bool_or(F.col("section") == "positives").alias("p"), F.bool_or(F.col("section") == "negatives").alias("n"))
    return found.filter("p AND n").select("game", "quote")


@query("r5_capped_facts")
def r5(spark, sf_dir):
    return evidence.capped_facts(evidence.facts(POINTS.df(spark), KEYS), KEYS).select(*KEYS, "fact_id", "topic", "sentiment", "rank")


@query("f7_specific_facts", f"""SELECT game, source_no, section, pos, len(list_filter(string_split(c, ' '), lambda w: w <> '')) >= 4 AND len(regexp_extract_all({_QUOTE}, '\\w[\\w''-]*')) <= 42 AND (NOT regexp_matches(c, {literal('|'.join(V.GENERIC_MARKERS))}) OR regexp_matches(c, {literal('|'.join(V.SPECIFIC_MARKERS))})) AS specific
    FROM (SELECT *, lower({s_clean_unescaped('point_fa')}) AS c FROM {POINTS.sql()})""")  # fmt: skip
def f7(spark, sf_dir):
    return POINTS.df(spark).select("game", "source_no", "section", "pos", evidence.is_specific(F.col("point_fa"), F.col("evidence_en")).alias("specific"))


# facts of customers: each order is one, with a topic, a sentiment and a site
_TOPICS = ["world_design", "gameplay", "story", "technical", "visuals", "audio", "general"]
FACTS_SQL = f"""(SELECT o_custkey AS article, 'F' || CAST(o_orderkey AS VARCHAR) AS fact_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 's' || CAST(o_orderkey % 4 AS VARCHAR) END AS site_name, list_extract([{names(_TOPICS)}], CAST(o_orderkey % 7 + 1 AS INTEGER)) AS topic,
  CASE o_orderstatus WHEN 'O' THEN 'positive' WHEN 'F' THEN 'negative' ELSE 'caution' END AS sentiment, CAST(o_orderkey % 3 AS INTEGER) AS specificity, CAST(10 + o_orderkey % 5 AS INTEGER) AS n FROM orders)"""


def _facts(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("article"), F.concat(F.lit("F"), k.cast("string")).alias("fact_id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("s"), (k % 4).cast("string"))).alias("site_name"),
        F.array(*(F.lit(t) for t in _TOPICS))[(k % 7).cast("int")].alias("topic"), F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative").otherwise("caution").alias("sentiment"),
        (k % 3).cast("int").alias("specificity"), F.repeat(F.lit("x"), (10 + k % 5).cast("int")).alias("text_fa"),
    )


def _plan_sql(plan, least) -> str:
    """Part by part: facts that no part before took, one of a site before any second."""
    steps, taken = [], ""
    by = "CASE WHEN site_name = '' THEN 1 ELSE 0 END, specificity DESC, n, fact_id"
    for at, (part, topics, sentiments, n) in enumerate(plan):
        steps.append(f"r{at} AS (SELECT *, CAST(row_number() OVER (PARTITION BY article, site_name ORDER BY {by}) > 1 AS INTEGER) AS again FROM f WHERE topic IN ({names(topics)}) AND sentiment IN ({names(sentiments)}){taken})")
        steps.append(f"p{at} AS (SELECT article, '{part}' AS part, fact_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY article ORDER BY again, {by}) AS INTEGER) AS place FROM r{at}) WHERE place <= {n})")
        taken += f" AND (article, fact_id) NOT IN (SELECT (article, fact_id) FROM p{at})"
    out = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(len(plan)))
    enough = " AND ".join(f"count(*) FILTER (part = '{p}') >= {n}" for p, n in least.items())
    kept = f"o AS ({out}), e AS (SELECT article FROM o GROUP BY article HAVING {enough}), k AS (SELECT * FROM o WHERE article IN (SELECT article FROM e))"
    firsts = "".join(f" UNION ALL SELECT article, '{part}', fact_id, CAST(list_position([{names(of)}], part) AS INTEGER) FROM k WHERE place = 1 AND part IN ({names(of)})" for part, of in evidence.SYNTHESIS.items())
    return f"WITH f AS (SELECT * FROM {FACTS_SQL}), {', '.join(steps)}, {kept} SELECT * FROM k{firsts}"


@query("r7_editorial_plan", _plan_sql(evidence.PLAN, evidence.LEAST))
def r7(spark, sf_dir):
    return evidence.editorial_plan(_facts(spark, sf_dir), ["article"])


@query("r7_long_plan", _plan_sql(evidence.LONG_PLAN, {"opening_positive": 1, "opening_negative": 1, "world_gameplay": 2, "friction": 2}))
def r7_long(spark, sf_dir):
    """The long-form plan, here with fewer facts than production asks for."""
    return evidence.editorial_plan(_facts(spark, sf_dir), ["article"], evidence.LONG_PLAN, {"opening_positive": 1, "opening_negative": 1, "world_gameplay": 2, "friction": 2})


@query(
    "r6_one_per_source",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k, o_totalprice FROM orders)
    SELECT o_orderkey, o_orderpriority FROM r ORDER BY CASE WHEN k > 1 THEN 1 ELSE 0 END, o_totalprice DESC, o_orderkey LIMIT 12""",
)
def r6(spark, sf_dir):
    from newsloom.operators import ordered

    return ordered.one_per_group_first(table(spark, sf_dir, "orders"), "o_orderpriority", 12, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority")


# --- validation ---------------------------------------------------------------------------------

ARTICLES = Rows(
    "id int, value string",
    [(1, ""), (2, "یک دو"), (3, "یک دو سه چهار پنج شش"), (4, "این متن خوب است ولی https://x.com دارد"), (5, "این متن نمره دارد و خوب است"), (6, "به دنیای بازی ما خوش آمدید دوست من"), (7, "این متن از IGN آمده و خوب است"), (8, "واژه " * 30)],
)
_WORDS = "len(list_filter(string_split(v, ' '), lambda w: w <> ''))"


@query(
    "f8_section_problem",
    f"""SELECT id, CASE WHEN v = '' THEN 'empty' WHEN {_WORDS} < 5 THEN 'short' WHEN {_WORDS} > 20 THEN 'long' WHEN regexp_matches(v, 'https?://|[#*`]|(?:^|\\s)-\\s') THEN 'markup' WHEN regexp_matches(lower(v), {literal('|'.join(V.FORBIDDEN_WORDS))}) THEN 'forbidden'
    WHEN contains(lower(v), 'ign') THEN 'site' WHEN regexp_matches(v, {literal('|'.join(V.TRAILER_WORDS))}) THEN 'trailer' END AS problem FROM (SELECT id, {s_clean_unescaped('value')} AS v FROM {ARTICLES.sql()})""",
)
def f8(spark, sf_dir):
    return ARTICLES.df(spark).select("id", evidence.section_problem(F.col("value"), ["IGN"], 5, 20).alias("problem"))


REWRITES = Rows("id int, old string, new string", [(1, "a b c 10 d", "a b 10 c"), (2, "a b c d", "a b c 7"), (3, "a b c d e f", "a b"), (4, "a b", "a b c d e f g h i j k l"), (5, "۱۲ a b", "12 a b c")])


@query(
    "f10_drift",
    f"""WITH n AS (SELECT id, len(list_filter(string_split(old, ' '), lambda w: w <> '')) AS n, len(list_filter(string_split(new, ' '), lambda w: w <> '')) AS m, regexp_extract_all(translate(old, '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '\\d+(?:\\.\\d+)?') AS a, regexp_extract_all(translate(new, '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '\\d+(?:\\.\\d+)?') AS b FROM {REWRITES.sql()})
    SELECT id, CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 THEN 'number' WHEN m < n * 0.5 THEN 'short' WHEN m > n * 1.35 + 8 THEN 'long' END AS problem FROM n""",
)
def f10(spark, sf_dir):
    return REWRITES.df(spark).select("id", evidence.drift_problem(F.col("old"), F.col("new")).alias("problem"))


QUEUE = Rows("id int, game string, platform string, metacritic_url string, review_urls array<string>", [(1, "A", "PC", "https://m.com/a", ["https://x.com/1"] * 5), (2, " ", "PC", "nope", ["https://x.com/1"]), (3, None, None, None, []), (4, "B", "PS5", "https://m.com/b", ["https://x.com/1"] * 11)])


@query(
    "f12_queue_validation",
    f"""SELECT id, array_to_string(list_filter([CASE WHEN trim(coalesce(game, '')) = '' THEN 'game' END, CASE WHEN trim(coalesce(platform, '')) = '' THEN 'platform' END, CASE WHEN trim(coalesce(metacritic_url, '')) = '' THEN 'no url' WHEN NOT regexp_matches(metacritic_url, '^https?://[^/]+') THEN 'bad url' END,
    CASE WHEN len(review_urls) < 5 THEN 'few reviews' END], lambda x: x IS NOT NULL), ',') AS errors FROM {QUEUE.sql()}""",
)
def f12(spark, sf_dir):
    return readers.queue_errors(QUEUE.df(spark)).select("id", F.array_join("errors", ",").alias("errors"))


FLAGS = Rows("id int, flag string, alias string", [(1, "Yes", None), (2, None, "on"), (3, "0", "true"), (4, None, None), (5, " TRUE ", "no")])


@query("f14_flags", f"SELECT id, lower(trim(coalesce(flag, alias, ''))) IN ('1', 'true', 'yes', 'on') AS wanted FROM {FLAGS.sql()}")
def f14(spark, sf_dir):
    return FLAGS.df(spark).select("id", text.is_true(F.coalesce("flag", "alias")).alias("wanted"))


# --- scores on pages ----------------------------------------------------------------------------

PAGES = Rows(
    "id int, host string, visible string, description string, page string",
    [
        (1, "wccftech.com", "Gaming Score 10 the best", "", "<p>none</p>"), (2, "wccftech.com", "Gaming 8.5 fine", "", ""), (3, "x.com", "Final score: 8/10. Rating 4 out of 5", "", ""), (4, "x.com", "user rating 9/10", "", ""),
        (5, "x.com", "", "", '<script type="application/ld+json">{"@type":"Review","reviewRating":{"ratingValue":"80","bestRating":"100"}}</script>'),
        (6, "x.com", "verdict 7/10", "", '<meta itemprop="ratingValue" content="9.5">'), (7, "x.com", "", "", '<span class="review-score">  91 / 100</span>'), (8, "y.com", "it took 30 hours", "", ""),
        (11, "x.com", "", "", '<script type="application/ld+json">{"@graph": [{"@type": ["CriticReview", "Review"], "itemReviewed": {"@type": "Game"}, "reviewRating": {"@type": "Rating", "ratingValue": 4, "bestRating": 5}}]}</script>'),
        (12, "x.com", "", "", '<script type="application/ld+json">{"@type": "Game", "review": {"@type": "Review", "ratingValue": "7/10"}}</script>'),
        (13, "x.com", "", "", '<meta name="user-reviewrating" content="9"><meta name="reviewrating" content="4.5" scale="5">'), (14, "www.wccftech.com", "Score: 9.5 of all the Gaming there is", "", ""),
        (15, "x.com", "", "", '<script type="application/ld+json">{"@type": "AggregateReview", "reviewRating": {"ratingValue": 3}}</script>'), (16, "wccftech.com", "user score Gaming 7", "", ""),
        (9, "m.com", "Metascore 88 and more", "Metascore: 77", ""), (10, "m.com", "Metascore based on 60 critic reviews 91", "", '"criticScoreSummary": {"score": 85, "reviewCount": 50}'),
    ],
)


@query(
    "a6_review_scores",
    "SELECT * FROM (VALUES (1, 10.0, 98, '10/10'), (2, 8.5, 98, '8.5/10'), (3, 8.0, 82, '8/10'), (5, 8.0, 100, '80/100'), (6, 9.5, 90, '9.5/10'), (7, 9.1, 86, '91/100'), (11, 8.0, 100, '4/5'), (12, 7.0, 95, '7/10'), (13, 9.0, 90, '4.5/5'), (14, 9.5, 98, '9.5/10')) AS t(id, score_10, confidence, shown)",
)
def a6(spark, sf_dir):
    s = PAGES.df(spark).select("id", scoring.review_score(F.col("page"), F.col("visible"), F.col("host")).alias("s")).filter("s IS NOT NULL")
    return s.select("id", F.col("s.score_10").alias("score_10"), F.col("s.confidence").alias("confidence"), F.col("s.shown").alias("shown"))


@query("a7_metascores", "SELECT * FROM (VALUES (9, 77, 88, NULL), (10, 85, 100, 50)) AS t(id, metascore, confidence, n_critics)")
def a7(spark, sf_dir):
    """Metascores and the critics behind them."""
    args = F.col("page"), F.col("visible"), F.col("description")
    s = PAGES.df(spark).select("id", scoring.metascore(*args).alias("s"), scoring.critic_reviews(*args).alias("c")).filter("s IS NOT NULL")
    return s.select("id", F.col("s.value").alias("metascore"), F.col("s.confidence").alias("confidence"), F.col("c.value").alias("n_critics"))


@query("m4_scorecard_display", "SELECT p_partkey, regexp_replace(printf('%.1f', round_even(p_retailprice / 10, 0) / 10), '\\.0$', '') AS shown FROM part")
def m4(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scores.number_text(F.bround(F.col("p_retailprice") / 10, 0) / 10).alias("shown"))
