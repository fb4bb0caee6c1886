"""Queries of operators that only the first generations had."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import blocks, text, url
from newsloom.operators import scoring, state
from newsloom.plans import completion
from newsloom.sources import sinks

from .base import Rows, query, s_clean, s_clean_unescaped, table

LISTS = Rows("id int, s string", [(1, "Alpha, beta،alpha\nGamma"), (2, ""), (3, None), (4, ",".join(f"t{k}" for k in range(12)))])


@query(
    "v2_list_fields",
    f"""WITH e AS (SELECT id, left({s_clean('x')}, 80) AS v, i FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_split_to_array(coalesce(s, ''), '[,،\\n]') AS l FROM {LISTS.sql()}))),
    d AS (SELECT *, row_number() OVER (PARTITION BY id, lower(v) ORDER BY i) AS r FROM e WHERE v <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM d WHERE r = 1)
    SELECT s.id AS id, coalesce(string_agg(v, '|' ORDER BY i), '') AS items FROM {LISTS.sql()} s LEFT JOIN n ON n.id = s.id AND k <= 8 GROUP BY s.id""",
)
def v2(spark, sf_dir):
    parts = F.filter(F.transform(F.split(text.blank(F.col("s")), "[,،\n]"), lambda x: F.substring(text.clean_text(x), 1, 80)), lambda x: x != "")
    return LISTS.df(spark).select("id", F.array_join(F.slice(text.ordered_distinct(parts, F.lower), 1, 8), "|").alias("items"))


@query("v4_word_counts")
def v4(spark, sf_dir):
    """Word counts of all documents, in any script."""
    return table(spark, sf_dir, "documents").select("doc_id", text.persian_word_count(F.col("text")).alias("n"))


PHOTOS = Rows("id int, large2x string, large string, original string, medium string", [(1, None, "l", "o", "m"), (2, "x", "l", "o", "m"), (3, "", None, "o", None), (4, None, None, None, None)])


@query("v1_photo_choice", f"SELECT id, coalesce(nullif(large2x, ''), nullif(large, ''), nullif(original, ''), nullif(medium, ''), '') AS url FROM {PHOTOS.sql()}")
def v1(spark, sf_dir):
    return PHOTOS.df(spark).select("id", F.coalesce(*(text.or_null(F.col(c)) for c in ("large2x", "large", "original", "medium")), F.lit("")).alias("url"))


FAQ = Rows("id int, question string, q string, answer string", [(1, "a" * 200, None, "b"), (2, None, "short", "c" * 600), (3, "", "", "x")])


@query("v3_faq", f"SELECT id, left(coalesce(nullif(question, ''), q), 160) AS question, left(answer, 500) AS answer FROM {FAQ.sql()} WHERE coalesce(nullif(question, ''), nullif(q, '')) IS NOT NULL AND coalesce(answer, '') <> ''")
def v3(spark, sf_dir):
    asked = F.coalesce(text.or_null(F.col("question")), text.or_null(F.col("q")))
    return FAQ.df(spark).filter(asked.isNotNull() & (text.blank(F.col("answer")) != "")).select("id", F.substring(asked, 1, 160).alias("question"), F.substring("answer", 1, 500).alias("answer"))


SLUGS = Rows("id int, s string", [(1, "نقد بازی  تازه!"), (2, "GTA VI — نقد"), (3, "")])


@query("v5_persian_slugs", f"SELECT id, left(regexp_replace(regexp_replace(lower(s), '[^0-9a-z\\x{{600}}-\\x{{6ff}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 105) AS slug FROM {SLUGS.sql()}")
def v5(spark, sf_dir):
    kept = F.regexp_replace(F.regexp_replace(F.lower("s"), "[^0-9a-z؀-ۿ]+", "-"), "^-+|-+$", "")
    return SLUGS.df(spark).select("id", F.substring(kept, 1, 105).alias("slug"))


@query(
    "v9_terminal_failures",
    "SELECT CAST(user_id AS BIGINT) AS id, CASE WHEN arg_max(event_type, event_id) = 'click' THEN 'failed' ELSE 'posted' END AS status, CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS retry_count FROM events GROUP BY user_id",
)
def v9(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "failed").otherwise("posted").alias("event"), F.col("event_id").alias("wp_post_id"), F.lit("r").alias("reason"), F.col("ts").cast("timestamp").alias("at"))
    start = e.select(F.col("user_id").alias("id")).distinct().selectExpr("id", "'pending' AS status", "CAST(NULL AS BIGINT) AS wp_post_id", "0 AS retry_count", "CAST(NULL AS TIMESTAMP) AS next_retry_at", "CAST(NULL AS STRING) AS last_error")
    return state.fold_events(start, log, terminal_failures=True).select("id", "status", "retry_count")


@query("v10_mime_default", "SELECT part.p_partkey, CASE WHEN contains(lower(p_name), 'png') THEN 'png' WHEN contains(lower(p_name), 'webp') THEN 'webp' WHEN contains(lower(p_name), 'gif') THEN 'gif' ELSE 'jpg' END AS ext FROM part UNION ALL SELECT -1, 'webp' UNION ALL SELECT -2, 'jpg' UNION ALL SELECT -3, 'png'")
def v10(spark, sf_dir):
    """The first generation's image type: whatever it does not know is jpg."""
    odd = spark.createDataFrame([(-1, "image/WEBP"), (-2, "image/avif"), (-3, "image/png; q=1")], "p_partkey bigint, p_name string")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").union(odd).select("p_partkey", url.image_type(F.col("p_name"), older=True).alias("ext"))


@query("k4_idempotent_drafts", """WITH d AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT 'k' || CAST(o_custkey AS VARCHAR) AS draft_key, o_orderkey AS created_at FROM d WHERE o_custkey % 10 <> 0""")
def k4(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    drafts = o.select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("draft_key"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slug"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("publish").alias("status"), F.col("o_orderkey").alias("created_at"))
    posts = o.filter("o_custkey % 10 = 0").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("draft_key"), F.lit("none").alias("slug"))
    return sinks.publish_drafts(drafts, posts).select("draft_key", "created_at")


@query("u14_draft_slugs", "SELECT p_partkey, left('review-' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 180) AS slug FROM part")
def u14(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sinks.draft_slug(F.col("p_name"), F.col("p_brand")).alias("slug"))


@query("l8_fallback_text", "SELECT doc_id, CASE WHEN t = '' THEN '' ELSE regexp_replace(t, '[.؟!?]+$', '') || '.' END AS text FROM (SELECT doc_id, " + s_clean("string_split(text, chr(10))[1]") + " AS t FROM documents)")
def l8(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.split("text", "\n")[0]).alias("facts"))
    return d.select("doc_id", completion.fallback_text(F.col("facts")).alias("text"))


CREDITS = Rows("id int, photographer string, page string", [(1, " Ann <b>B</b>", "https://p.com/1"), (2, "", "https://p.com/2"), (3, "Ann", ""), (4, None, None)])
_A = "'<a href=\"' || page || '\" target=\"_blank\" rel=\"nofollow noopener\">Link</a>'"


@query("v1_photo_credits", f"SELECT id, '<p><small>Image: Pexels' || CASE WHEN coalesce(page, '') = '' THEN '' WHEN {s_clean('photographer')} = '' THEN ' — ' || {_A} ELSE ' — ' || {s_clean('photographer')} || ' — ' || {_A} END || '</small></p>' AS credit FROM {CREDITS.sql()}")
def v1_credits(spark, sf_dir):
    return CREDITS.df(spark).select("id", blocks.attribution(F.col("photographer"), F.col("page")).alias("credit"))


@query(
    "v3_faq_html",
    """SELECT n_regionkey AS region, '<h2>سوالات متداول</h2>' || chr(10) || string_agg('<h3>' || n_name || '?</h3>' || chr(10) || '<p>A &amp; ' || CAST(n_nationkey AS VARCHAR) || '</p>', chr(10) ORDER BY n_nationkey) AS html
    FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r <= 4 GROUP BY n_regionkey""",
)
def v3_html(spark, sf_dir):
    """Nations as questions about their region."""
    x = F.struct("n_nationkey", F.concat("n_name", F.lit("?")).alias("question"), F.concat(F.lit("A & "), F.col("n_nationkey").cast("string")).alias("answer"))
    lists = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list(x)).alias("l"))
    return lists.select("region", blocks.faq(F.col("l")).alias("html"))


@query(
    "t26_short_lists",
    f"""WITH w AS (SELECT doc_id, {s_clean_unescaped("x")} AS v, k FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))), f AS (SELECT doc_id, v, min(k) AS k FROM w WHERE v <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f) SELECT d.doc_id AS doc_id, coalesce(string_agg(md5(v), ',' ORDER BY k) FILTER (n <= 4), '') AS lines FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
)
def t26_lists(spark, sf_dir):
    """The first four different lines of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.short_list(F.split(text.blank(F.col("text")), "\n")).alias("l"))
    return d.select("doc_id", F.array_join(F.transform("l", F.md5), ",").alias("lines"))


@query("f6_public_sources", "SELECT o_orderkey, coalesce(nullif(trim(CASE o_orderstatus WHEN 'O' THEN 'acceptable' WHEN 'F' THEN ' ' ELSE 'needs_review' END), ''), CASE WHEN o_custkey % 2 = 0 THEN 'acceptable' ELSE '' END) = 'acceptable' AS eligible FROM orders")
def f6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = F.when(F.col("o_orderstatus") == "O", "acceptable").when(F.col("o_orderstatus") == "F", " ").otherwise("needs_review")
    return o.select("o_orderkey", scoring.eligible(now, F.when(F.col("o_custkey") % 2 == 0, "acceptable")).alias("eligible"))
