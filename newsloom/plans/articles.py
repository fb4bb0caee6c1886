"""Queries of article operators: backing, section checks, citations, points, reports, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions import vocabulary as V
from newsloom.operators import articles, evidence

from .base import Rows, literal, names, query, s_clean_unescaped, s_trim, table
from .review import CARD, CLASSED, KEYS, POINTS, card

SENTENCES = Rows(
    "id int, s string",
    [
        (1, "این بازی غنی و عالی است."), (2, "این بازی با نبرد غنی پیش می‌رود."), (3, "این بازی غنی نیست."), (4, "ساده و روشن."), (5, ""), (6, None), (7, "تصاویر چشم‌نواز، بدون هیچ شتاب"), (8, "جهان زیبا &amp; درخشان"),
    ],
)


def s_holds(x: str, words: list[str]) -> str:
    return f"len(list_filter([{names(words)}], lambda w: contains({x}, w))) > 0"


@query("f9_unbacked_sentences", f"SELECT id, {s_holds('s', V.PROSE_ADJECTIVES)} AND NOT {s_holds('s', V.PROSE_DETAILS)} AND NOT {s_holds('s', V.PROSE_NEGATIONS)} AS unbacked FROM (SELECT id, lower({s_clean_unescaped('s')}) AS s FROM {SENTENCES.sql()})")
def f9(spark, sf_dir):
    return SENTENCES.df(spark).select("id", articles.unbacked(F.col("s")).alias("unbacked"))


def s_first(x: str, words: list[str]) -> str:
    return f"list_extract(list_filter([{names(words)}], lambda w: contains({x}, w)), 1)"


CLAIMS = Rows(
    "id int, part string, s string",
    [
        (1, "opening", "تجربه‌ای دوگانه است. نبرد خوب است."), (2, "friction", "تجربه‌ای دوگانه است."), (3, "opening", "نبرد خوب است. این بازی عالی است. دیگر هیچ."), (4, "audience", "این بازی عالی است."),
        (5, "audience", "کمی صبر کنید تا ارزان شود."), (6, "conclusion", "نیاز به بهبود دارد و مشکلات جدی هم."), (7, "world_gameplay", "کاوش در جهان پویا است."), (8, "friction", ""),
    ],
)


@query(
    "f9_claim_problems",
    f"""WITH c AS (SELECT id, part, v, lower(v) AS f FROM (SELECT id, part, {s_clean_unescaped('s')} AS v FROM {CLAIMS.sql()})),
    s AS (SELECT *, list_filter(string_split(regexp_replace(v, '([.!؟?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '' AND {s_holds('lower(x)', V.PROSE_ADJECTIVES)} AND NOT {s_holds('lower(x)', V.PROSE_DETAILS)} AND NOT {s_holds('lower(x)', V.PROSE_NEGATIONS)}) AS bad FROM c)
    SELECT id, coalesce(CASE part {' '.join(f"WHEN '{p}' THEN 'phrase: ' || {s_first('f', w)}" for p, w in V.PART_PHRASES.items())} END, 'general: ' || {s_first('f', V.EMPTY_PHRASES)}, CASE WHEN part IN ({names(V.FACTUAL_PARTS)}) AND len(bad) > 0 THEN 'sentence: ' || bad[1] END) AS problem FROM s""",
)
def f9_claims(spark, sf_dir):
    return CLAIMS.df(spark).select("id", articles.claim_problem(F.col("part"), F.col("s")).alias("problem"))


# supports of orders: an order is an article, its line numbers are parts, its parts' facts have sentiments by their supplier
_SENTIMENT = "CASE l_suppkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'caution' ELSE 'neutral' END"


def _supports(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), (F.col("l_linenumber") % 2).cast("string").alias("part"), F.col("l_partkey").cast("string").alias("fact_id"), "l_suppkey", "l_linenumber")
    kind = F.col("l_suppkey") % 4
    sentiment = F.when(kind == 0, "positive").when(kind == 1, "negative").when(kind == 2, "caution").otherwise("neutral")
    facts = li.groupBy("article", "fact_id").agg(F.min_by(sentiment, F.struct("l_linenumber", "l_suppkey")).alias("sentiment"), F.min_by(F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")), F.struct("l_linenumber", "l_suppkey")).alias("topic"))
    return li.select("article", "part", "fact_id"), facts


_FACTS = f"f AS (SELECT l_orderkey AS article, l_partkey AS fact, arg_min({_SENTIMENT}, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) AS sentiment, arg_min('t' || CAST(l_suppkey % 3 AS VARCHAR), CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) AS topic FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT l_orderkey AS article, CAST(l_linenumber % 2 AS VARCHAR) AS part, l_partkey AS fact FROM lineitem)"


@query("f11_balanced_supports", f"WITH {_FACTS} SELECT article, part, bool_or(sentiment = 'positive') AND bool_or(sentiment IN ('negative', 'caution')) AS balanced FROM s JOIN f USING (article, fact) GROUP BY ALL")
def f11(spark, sf_dir):
    return articles.balanced_supports(*_supports(spark, sf_dir), ["article"])


@query(
    "f8_supports",
    f"WITH {_FACTS} SELECT article, part, CASE WHEN count(*) < 2 THEN 'supports' WHEN NOT bool_or(topic IN ('t0', 't1')) THEN 'topic' WHEN NOT bool_or(sentiment = 'positive') THEN 'sentiment' END AS problem FROM s JOIN f USING (article, fact) GROUP BY ALL",
)
def f8_supports(spark, sf_dir):
    """What is wrong with the supports of each section: their number, topics or sentiments."""
    return articles.supports_problem(*_supports(spark, sf_dir), ["article"], 2, ["t0", "t1"], ["positive"])


# sections of documents: a document is an article, its first five lines are parts
_BOUNDS = {"opening": (3, 60), "world_gameplay": (5, 80), "friction": (5, 80), "audience": (2, 60), "conclusion": (2, 60)}
_PARTS = list(_BOUNDS)
_V = s_clean_unescaped("l")
_N = "len(list_filter(string_split(v, ' '), lambda w: w <> ''))"
_LOW, _HIGH = (f"CASE part {' '.join(f'''WHEN '{p}' THEN {b[k]}''' for p, b in _BOUNDS.items())} END" for k in (0, 1))
_FORBIDDEN = "|".join(w.lower() for w in V.FORBIDDEN_WORDS)
_CHECKED = f"""p AS (SELECT doc_id, unnest([{names(_PARTS)}]) AS part, unnest(range(1, 6)) AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, part, k, ls[k] AS l FROM p WHERE len(ls) >= k),
  v AS (SELECT doc_id, part, k, {_V} AS v FROM l), n AS (SELECT *, {_N} AS words, lower(v) AS f FROM v),
  c AS (SELECT *, CASE WHEN v = '' THEN 'empty' WHEN contains(v, chr(65533)) THEN 'broken' WHEN words < {_LOW} THEN 'short' WHEN words > {_HIGH} THEN 'long' WHEN regexp_matches(v, 'https?://|[#*`]|(?:^|\\s)-\\s') THEN 'markup'
    WHEN regexp_matches(f, {literal(_FORBIDDEN)}) THEN 'forbidden' WHEN contains(f, 'hare') THEN 'site' WHEN regexp_matches(f, {literal('|'.join(V.TRAILER_WORDS))}) THEN 'trailer' END AS problem FROM n)"""


def _sections(spark, sf_dir):
    lines = F.split(text.blank(F.col("text")), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(lines, 1, 5)).alias("k", "text_fa"))
    part = F.array(*(F.lit(p) for p in _PARTS))[F.col("k")]
    return articles.checked_sections(d.select("doc_id", part.alias("part"), "text_fa"), _BOUNDS, ["Hare"])


@query("f13_checked_sections", f"WITH {_CHECKED} SELECT doc_id, part, CAST(words AS INTEGER) AS words, problem FROM c")
def f13(spark, sf_dir):
    """Each section against the bounds of its part."""
    return _sections(spark, sf_dir).select("doc_id", "part", "words", "problem")


@query(
    "f13_article_verdicts",
    f"""WITH {_CHECKED}, a AS (SELECT doc_id, CAST(sum(words) AS INTEGER) AS words, count(*) AS n, arg_min(part || ': ' || problem, k) FILTER (problem IS NOT NULL) AS first FROM c GROUP BY doc_id)
    SELECT doc_id, words, CASE WHEN n < 5 THEN list_extract([{names(_PARTS)}], CAST(n + 1 AS INTEGER)) || ': missing' ELSE first END AS problem FROM a""",
)
def f13_articles(spark, sf_dir):
    """The first problem of each article, in the order of its parts."""
    return articles.article_verdicts(_sections(spark, sf_dir), ["doc_id"], _BOUNDS)


@query(
    "r10_chosen_candidates",
    """WITH c AS (SELECT o_custkey AS article, o_orderkey AS attempt, CAST(floor(o_totalprice / 250) AS INTEGER) AS words FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY words NOT BETWEEN 800 AND 1000, abs(words - 900), attempt) AS k FROM c)
    SELECT article, attempt, words, words BETWEEN 800 AND 1000 AS target_met FROM r WHERE k = 1""",
)
def r10(spark, sf_dir):
    """Orders as attempts at an article: one within the target, or the nearest to it, or the first."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article"), F.col("o_orderkey").alias("attempt"), F.floor(F.col("o_totalprice") / 250).cast("int").alias("words"))
    return articles.chosen_candidate(c, ["article"])


# citations: orders are articles, lines are blocks; a ref is a supplier's quote, a card of two, or META
@query(
    "j9_citations",
    """WITH s AS (SELECT l_orderkey AS article, l_linenumber % 2 AS block, l_linenumber AS pos, CASE WHEN l_partkey % 5 = 0 THEN 'META' WHEN l_partkey % 5 = 1 THEN 'C' || CAST(l_suppkey % 10 AS VARCHAR) ELSE 'Q' || CAST(l_suppkey % 50 AS VARCHAR) END AS ref FROM lineitem),
    q AS (SELECT 'Q' || CAST(s_suppkey % 50 AS VARCHAR) AS ref, 'site ' || CAST(s_suppkey % 7 AS VARCHAR) AS site, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'https://s.com/' || CAST(s_suppkey % 13 AS VARCHAR) END AS url FROM supplier WHERE s_suppkey < 50),
    c AS (SELECT 'C' || CAST(k AS VARCHAR) AS card, a AS spot, 'Q' || CAST((k * 3 + a) % 50 AS VARCHAR) AS ref FROM (SELECT unnest(range(0, 10)) AS k), (SELECT unnest(range(0, 2)) AS a)),
    e AS (SELECT article, block, pos, 0 AS spot, site, url FROM s JOIN q USING (ref) UNION ALL SELECT article, block, pos, spot, site, url FROM s JOIN c ON s.ref = card JOIN q ON c.ref = q.ref UNION ALL SELECT article, block, pos, 0, 'Metacritic', 'https://m.com/' || CAST(article % 11 AS VARCHAR) FROM s WHERE ref = 'META'),
    f AS (SELECT article, block, site, url, min(pos * 10 + spot) AS first FROM e WHERE url <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY article, block ORDER BY first, site, url) AS place FROM f)
    SELECT article, CAST(block AS INTEGER) AS block, ' ' || string_agg('[' || site || '](' || url || ')', ' ' ORDER BY place) AS links FROM r WHERE place <= 3 GROUP BY article, block""",
)
def j9(spark, sf_dir):
    """Up to three sources of each block, as links."""
    li = table(spark, sf_dir, "lineitem")
    n = lambda c, m: (F.col(c) % m).cast("string")
    kind = F.col("l_partkey") % 5
    ref = F.when(kind == 0, "META").when(kind == 1, F.concat(F.lit("C"), n("l_suppkey", 10))).otherwise(F.concat(F.lit("Q"), n("l_suppkey", 50)))
    supports = li.select(F.col("l_orderkey").alias("article"), (F.col("l_linenumber") % 2).cast("int").alias("block"), F.col("l_linenumber").alias("pos"), ref.alias("ref"))
    quote = table(spark, sf_dir, "supplier").filter("s_suppkey < 50").select(F.concat(F.lit("Q"), n("s_suppkey", 50)).alias("ref"), F.concat(F.lit("site "), n("s_suppkey", 7)).alias("site_name"), F.when(F.col("s_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("https://s.com/"), n("s_suppkey", 13))).alias("url"))
    cards = spark.range(10).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("card"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"), "id").select("card", "at", F.concat(F.lit("Q"), ((F.col("id") * 3 + F.col("at")) % 50).cast("string")).alias("ref"))
    # every article knows the quotes and cards that it refers to
    used = supports.select("article", "ref").distinct()
    own_cards = used.join(cards.withColumnRenamed("ref", "quote"), used["ref"] == cards["card"]).select("article", "card", "at", F.col("quote").alias("ref"))
    own_quotes = used.union(own_cards.select("article", "ref")).distinct().join(quote, "ref")
    meta = used.filter("ref = 'META'").select("article", F.concat(F.lit("https://m.com/"), n("article", 11)).alias("url"))
    cited = articles.citations(supports, own_quotes, own_cards, meta, ["article"])
    return articles.rendered_citations(cited, ["article"]).select("article", "block", "links")


@query(
    "r9_article_points",
    f"""WITH c AS (SELECT game, section, {s_clean_unescaped('point_fa')} AS fa, site_name, source_no, pos FROM {POINTS.sql()}), f AS (SELECT game, section, lower(fa) AS k, min(source_no * 1000 + pos) AS spot, arg_min(fa, source_no * 1000 + pos) AS fa, arg_min(site_name, source_no * 1000 + pos) AS site FROM c WHERE fa <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY game, section ORDER BY spot) AS place FROM f) SELECT game, section, CAST(place AS INTEGER) AS place, '- ' || fa || ' (' || coalesce(nullif(site, ''), {literal(articles.UNKNOWN_SITE)}) || ')' AS line FROM r WHERE place <= 6""",
)
def r9(spark, sf_dir):
    p = articles.article_points(POINTS.df(spark).withColumn("url", F.lit("")), ["game"])
    return p.select("game", "section", F.col("place").cast("int").alias("place"), articles.point_line(F.col("point_fa"), F.col("site_name"), F.col("url")).alias("line"))


@query(
    "r9_card_points",
    f"""WITH c AS (SELECT game, platform, CASE category WHEN 'audio' THEN 'visuals' ELSE category END AS category, sentiment, point_fa, row_number() OVER (PARTITION BY game, platform, CASE category WHEN 'audio' THEN 'visuals' ELSE category END, sentiment ORDER BY source_no, CASE section WHEN 'positives' THEN 1 WHEN 'negatives' THEN 2 ELSE 3 END, pos) AS place
    FROM {CLASSED} WHERE sentiment IN ('positive', 'negative')) SELECT game, platform, category, sentiment, CAST(place AS INTEGER) AS place, point_fa FROM c WHERE place <= 2""",
)
def r9_cards(spark, sf_dir):
    return articles.card_points(POINTS.df(spark), KEYS).select(*KEYS, "category", "sentiment", F.col("place").cast("int").alias("place"), "point_fa")


_REF = "'S' || CAST(source_no AS VARCHAR) || ':' || section || ':' || CAST(pos AS VARCHAR)"


@query("a3_evidence_index", f"SELECT game, platform, {_REF} AS ref, category IS NULL AS uncategorised FROM {CLASSED} WHERE {s_clean_unescaped('point_fa')} <> '' AND q <> ''")
def a3(spark, sf_dir):
    index = articles.evidence_index(POINTS.df(spark), KEYS)
    loose = articles.uncategorised(index, KEYS).withColumn("uncategorised", F.lit(True))
    return index.join(loose, [*KEYS, "ref"], "left").select(*KEYS, "ref", F.coalesce("uncategorised", F.lit(False)).alias("uncategorised"))


_CLEAN = """len(regexp_extract_all(q, '[\\w][\\w''-]*')) BETWEEN 8 AND 26 AND fa <> '' AND q <> '' AND compatible"""


def _compatible(fa: str, en: str) -> str:
    return "(" + " AND ".join(f"(NOT regexp_matches({fa}, {literal('|'.join(t))}) OR regexp_matches({en}, {literal('(?i)(?:' + '|'.join(p) + ')')}))" for t, p in V.CLAIM_DOMAINS) + ")"


_POINTS = f"(SELECT *, {_compatible('fa', 'lower(q)')} AS compatible FROM (SELECT *, {s_clean_unescaped('point_fa')} AS fa, {s_clean_unescaped('evidence_en')} AS q FROM {POINTS.sql()}))"


@query(
    "f4_verified_points",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY game, platform, section, lower(q) ORDER BY pos * 1000 + source_no) AS r FROM {_POINTS} WHERE {_CLEAN}), p AS (SELECT *, row_number() OVER (PARTITION BY game, platform, section ORDER BY pos * 1000 + source_no) AS place FROM c WHERE r = 1)
    SELECT game, platform, section, CAST(place AS INTEGER) AS place, q AS evidence_en FROM p WHERE place <= 4""",
)
def f4(spark, sf_dir):
    ordered = POINTS.df(spark).withColumn("pos", F.col("pos") * 1000 + F.col("source_no"))
    return articles.verified_points(ordered, KEYS).select(*KEYS, "section", F.col("place").cast("int").alias("place"), "evidence_en")


@query(
    "f5_upgraded_points",
    f"""WITH b AS (SELECT *, source_no AS f, CASE section WHEN 'positives' THEN 1 WHEN 'negatives' THEN 2 ELSE 3 END AS s FROM {_POINTS} WHERE {_CLEAN}),
    o AS (SELECT *, row_number() OVER (PARTITION BY game, platform, lower(q) ORDER BY s, f = 1, pos * 1000 + source_no) AS r FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY game, platform, section ORDER BY f = 1, pos * 1000 + source_no) AS place FROM o WHERE r = 1)
    SELECT game, platform, section, CAST(place AS INTEGER) AS place, q AS evidence_en FROM p WHERE place <= 6""",
)
def f5_upgraded(spark, sf_dir):
    """Points of later sources as fresh ones, those of the first as the cached ones."""
    p = POINTS.df(spark).withColumn("pos", F.col("pos") * 1000 + F.col("source_no"))
    return articles.upgraded(p.filter("source_no = 1"), p.filter("source_no <> 1"), KEYS).select(*KEYS, "section", F.col("place").cast("int").alias("place"), "evidence_en")


MANUAL_POINTS = Rows("id int, fa string, en string", [(1, "خوب است", "one two three four five six seven eight"), (2, "خو", "one two three four five six seven eight"), (3, "خوب است", "one two three"), (4, "خوب است", "word " * 22), (5, "خوب است", "word " * 23), (6, None, None)])


@query("f3_manual_points", f"SELECT id, length(fa) >= 3 AND length(q) >= 8 AND len(regexp_extract_all(q, '[\\w][\\w''-]*')) BETWEEN 8 AND 22 AS valid FROM (SELECT id, {s_clean_unescaped('fa')} AS fa, {s_clean_unescaped('en')} AS q FROM {MANUAL_POINTS.sql()})")
def f3(spark, sf_dir):
    return MANUAL_POINTS.df(spark).select("id", evidence.manual_point_valid(F.col("fa"), F.col("en")).alias("valid"))


# quality rows over documents: a source of a game is a document's, its audit comes from labels
_AUDIT = """a AS (SELECT source AS game, d.doc_id AS site, CASE WHEN quality = 1 THEN 'acceptable' ELSE 'needs_review' END AS status, n_chars % 5 AS points, CASE WHEN d.doc_id % 6 = 0 THEN 2 END AS manual, CASE WHEN d.doc_id % 4 = 0 THEN 2 ELSE 0 END AS failed, d.doc_id % 4 = 0 AS review FROM documents d JOIN labels USING (doc_id)),
  q AS (SELECT *, CASE WHEN manual > 0 AND status = 'acceptable' THEN 'manual_supported' WHEN review AND status = 'needs_review' THEN 'manual_review' ELSE status END AS final FROM a)"""


def _audits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return articles.quality_rows(
        d.select(
            F.col("source").alias("game"), F.col("doc_id").cast("string").alias("site_name"), F.when(F.col("quality") == 1, "acceptable").otherwise("needs_review").alias("status"), (F.col("n_chars") % 5).alias("verified_points"), (F.col("n_chars") % 5).alias("categorised_points"),
            F.when(F.col("doc_id") % 6 == 0, 2).alias("manual_points"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(0).alias("failed"), (F.col("doc_id") % 4 == 0).alias("manual_review"),
        ),
        ["game"],
    )


@query("a12_quality_rows", f"WITH {_AUDIT} SELECT game, CAST(site AS VARCHAR) AS site_name, final AS status, CAST(points AS BIGINT) AS verified_points, CASE final {' '.join(f'''WHEN '{k}' THEN {literal(v)}''' for k, v in V.QUALITY_ACTIONS.items())} END AS action_fa, final IN ('acceptable', 'manual_supported') AS usable FROM q")
def a12_rows(spark, sf_dir):
    """Every labelled document as a source of its site: what was done about its evidence."""
    return _audits(spark, sf_dir).select("game", "site_name", "status", "verified_points", "action_fa", "usable")


@query(
    "a12_incomplete_reports",
    f"""WITH {_AUDIT} SELECT game, count(*) FILTER (final IN ('acceptable', 'manual_supported')) AS n_usable, count(*) AS n_sources, CAST(100000 - count(*) FILTER (final IN ('acceptable', 'manual_supported')) AS BIGINT) AS needed,
    coalesce(string_agg(CAST(site AS VARCHAR), ',' ORDER BY CAST(site AS VARCHAR)) FILTER (final NOT IN ('acceptable', 'manual_supported')), '') AS thin FROM q GROUP BY game""",
)
def a12_reports(spark, sf_dir):
    """Reports of the sites whose sources are too few."""
    r = articles.incomplete_report(_audits(spark, sf_dir), ["game"], 100_000)
    return r.select("game", "n_usable", "n_sources", F.col("needed").cast("bigint").alias("needed"), F.array_join("thin_sources.site_name", ",").alias("thin"))


@query("a13_counters", "SELECT count(*) AS added, count(*) FILTER (event_type = 'view') AS posted, CAST(sum(user_id) AS BIGINT) AS words FROM events")
def a13(spark, sf_dir):
    return articles.counters(table(spark, sf_dir, "events"), F.col("event_type") == "view", F.col("user_id"))


@query("t17_tidy_articles", f"""SELECT page_id, md5({s_trim(f"regexp_replace({s_trim(f'''regexp_replace({s_trim('html')}, '\\s*<\\s*$', '')''')}, '(?im)\\b(برای اطلاعات بیشتر.*|جزئیات بیشتر.*|در منبع.*)\\b', '', 'g')")}) AS digest FROM pages""")
def t17(spark, sf_dir):
    from newsloom.functions import html

    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.tidy_article(F.col("html"))).alias("digest"))




def _told(kind: str, around: tuple[str, str], lead: str = "''") -> str:
    return f"CASE WHEN {kind} IS NOT NULL THEN {lead} || {literal(around[0])} || {kind} || {literal(around[1])} END"


_LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN {literal(x)}" for k, x in V.SCORECARD_LABELS.items()) + " END"
_PLACE = f"list_position([{names(V.SCORECARD_CATEGORIES)}], category)"


@query(
    "l8_card_sentences",
    f"""WITH t AS (SELECT game, platform, {", ".join(f"string_agg({_LABEL}, '، ' ORDER BY {_PLACE}) FILTER ({c}) AS {k}" for k, c in (("positive", "trend = 'positive'"), ("negative", "trend = 'negative'"), ("other", "trend NOT IN ('positive', 'negative')")))} FROM {CARD} GROUP BY ALL)
    SELECT game, platform, concat_ws(' ', {", ".join(_told(k, V.TREND_SENTENCES[k]) for k in ("positive", "negative", "other"))}) AS summary,
    coalesce(nullif(concat_ws(' ', {_told("positive", V.AUDIENCE_SENTENCES["positive"], "game")}, {_told("negative", V.AUDIENCE_SENTENCES["negative"])}), ''), {literal(V.AUDIENCE_SENTENCES["none"][0])} || game || {literal(V.AUDIENCE_SENTENCES["none"][1])}) AS audience FROM t""",
)
def l8_sentences(spark, sf_dir):
    """What the trends of a scorecard say, and for whom."""
    return articles.card_sentences(card(spark), KEYS, "game")


_SOURCES = Rows("game string, source_no int, site_name string, url string, original_score string, review_score_10 double", [("A", 1, "IGN", "https://ign.com/r", "8/10", 8.0), ("A", 2, "Kotaku", "", None, None), ("A", 3, "Polygon", "https://p.com", "6/10", 6.0), ("B", 1, "", "", "7/10", 7.0), ("C", 1, "VG247", "", "9/10", 9.0), ("C", 2, "X", "", "8.5", 8.5)])


@query(
    "l8_site_differences",
    f"""WITH p AS (SELECT game, source_no, arg_min({s_clean_unescaped("point_fa")}, CASE section WHEN 'negatives' THEN 1000 ELSE 2000 END + pos) AS h FROM {POINTS.sql()} WHERE section IN ('negatives', 'positives') AND {s_clean_unescaped("point_fa")} <> '' GROUP BY ALL),
    r AS (SELECT s.game AS game, s.source_no AS source_no, review_score_10 AS score, '| ' || CASE WHEN url <> '' THEN '[' || coalesce(nullif(site_name, ''), {literal(articles.UNKNOWN_SITE)}) || '](' || url || ')' ELSE coalesce(nullif(site_name, ''), {literal(articles.UNKNOWN_SITE)}) END || ' | ' || coalesce(original_score, {literal(V.NO_SCORE)}) || ' | ' || coalesce(h, {literal(V.NO_HIGHLIGHT)}) || ' |' AS line
      FROM {_SOURCES.sql()} s LEFT JOIN p ON p.game = s.game AND p.source_no = s.source_no)
    SELECT game, CASE WHEN count(score) >= 2 THEN CASE WHEN max(score) - min(score) >= 1.5 THEN {literal(V.SPREAD_SENTENCES[0])} || CAST(max(score) - min(score) AS VARCHAR) || {literal(V.SPREAD_SENTENCES[1])} ELSE {literal(V.SPREAD_SENTENCES[2])} END || chr(10) || chr(10) ELSE '' END
      || '| منبع | نمره | نکته‌ی متمایزکننده |' || chr(10) || '|---|---:|---|' || chr(10) || string_agg(line, chr(10) ORDER BY source_no) AS text FROM r GROUP BY game""",
)
def l8_differences(spark, sf_dir):
    """How far the sources of a game are apart, with a point of each."""
    points = POINTS.df(spark).filter("platform = 'PC' OR game <> 'A'")
    return articles.site_differences(_SOURCES.df(spark), points, ["game"])
