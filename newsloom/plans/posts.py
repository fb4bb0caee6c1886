"""Queries of operators on published posts, localization pages, caches, settings, and of older generations' variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import settings
from newsloom.functions import blocks, dates, http, text, udfs, url
from newsloom.functions import vocabulary as V
from newsloom.operators import ordered, posts, similarity, state
from newsloom.sources import readers, sinks

from .base import Rows, names, query, s_cache_url, s_clean, s_identity, s_title, s_tokens, table
from .ingest import ITEMS_SQL, RUN, items

# posts are parts: their names are titles; items are titles made of the words of a name
_TITLE = "p_name || ' ' || p_brand || ' ' || p_type"


def _post_table(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("post_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"), F.col("p_partkey").alias("published_ts"))


def _title_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", F.lit("the"), "p_name", "p_brand").alias("title"))


_WORDS = lambda x, n: f"list_distinct(list_slice({s_tokens(s_title(x))}, 1, {n}))"


@query(
    "s13_posts_by_words",
    f"""WITH a AS (SELECT id, w FROM (SELECT p_partkey AS id, {_WORDS("p_type || ' the ' || p_name || ' ' || p_brand", 4)} AS w FROM part WHERE p_partkey % 2 = 0) WHERE len(w) > 0),
    b AS (SELECT p_partkey AS post_id, list_distinct(string_split(trim(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', ' ', 'g')), ' ')) AS t FROM part),
    u AS (SELECT id, len(w) AS n, unnest(w) AS word FROM a), v AS (SELECT post_id, unnest(t) AS word FROM b),
    m AS (SELECT id, post_id FROM u JOIN v USING (word) GROUP BY id, post_id, n HAVING count(*) = n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY post_id DESC) AS place FROM m) SELECT id, post_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""",
)
def s13(spark, sf_dir):
    """The newest posts that hold all of an item's first words."""
    return posts.found_by_words(_title_items(spark, sf_dir), _post_table(spark, sf_dir), 4).withColumn("place", F.col("place").cast("int"))


@query("j3_similar_posts")
def j3(spark, sf_dir):
    """The most similar post of each item, of those a search for its words finds."""
    return posts.similar_posts(_title_items(spark, sf_dir), _post_table(spark, sf_dir))


# terms are brands; tags of an item are its brand, its type and its name
_KEY = lambda x: f"trim(regexp_replace(regexp_replace(lower({s_clean(x)}), '[^0-9a-z\\x{{600}}-\\x{{6ff}}+&'' -]+', ' ', 'g'), ' +', ' ', 'g'))"
_TAGS = "SELECT p_partkey AS id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE upper(p_brand) || '!' END AS name FROM part, (SELECT unnest(range(0, 3)) AS pos)"


def _tags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tags = p.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.upper("p_brand"), F.lit("!")))).alias("pos", "name"))
    terms = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("term_id")).select("term_id", "name")
    return posts.resolved_tags(tags, terms)


@query(
    "j5_resolved_tags",
    f"""WITH t AS ({_TAGS}), k AS (SELECT {_KEY('p_brand')} AS key, min(p_partkey) AS term_id FROM part GROUP BY 1) SELECT id, pos, {_KEY('name')} AS key, term_id IS NULL AS created, coalesce(term_id, -1) AS term_id FROM t LEFT JOIN k ON k.key = {_KEY('t.name')} WHERE {_KEY('name')} <> ''""",
)
def j5(spark, sf_dir):
    """Terms of all tags by key; those to be made are shown as -1."""
    return _tags(spark, sf_dir).select("id", "pos", "key", "created", F.when(F.col("created"), -1).otherwise(F.col("term_id")).alias("term_id"))


@query("j5_tag_ids", f"WITH t AS ({_TAGS}), k AS (SELECT {_KEY('p_brand')} AS key, min(p_partkey) AS term_id FROM part GROUP BY 1), f AS (SELECT id, term_id, min(pos) AS pos FROM t JOIN k ON k.key = {_KEY('t.name')} GROUP BY ALL) SELECT id, string_agg(CAST(term_id AS VARCHAR), ',' ORDER BY pos) AS term_ids FROM f GROUP BY id")
def j5_ids(spark, sf_dir):
    """Distinct known term ids of each item, in the order of its tags."""
    return posts.tag_ids(_tags(spark, sf_dir).filter("NOT created")).select("id", F.array_join(F.transform("term_ids", lambda x: x.cast("string")), ",").alias("term_ids"))


@query("j5_new_terms", f"WITH t AS ({_TAGS}), k AS (SELECT DISTINCT {_KEY('p_brand')} AS key FROM part) SELECT arg_min(name, id * 10 + pos) AS name FROM t WHERE {_KEY('name')} NOT IN (SELECT key FROM k) GROUP BY {_KEY('name')}")
def j5_new(spark, sf_dir):
    """Names of the terms to be made, one for each key."""
    return posts.new_terms(_tags(spark, sf_dir)).select("name")


@query(
    "j6_related",
    f"""WITH c AS (SELECT page_id AS id, url AS link, 0 AS prio FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, url, 1 FROM pages WHERE page_id % 2 = 0),
    f AS (SELECT id, link, min(prio) AS prio FROM c WHERE {s_identity('link')} NOT IN (SELECT {s_identity('url')} FROM pages WHERE page_id % 4 = 0) GROUP BY id, link)
    SELECT id, link, CAST(prio AS INTEGER) AS prio FROM f ORDER BY prio, id LIMIT 40""",
)
def j6(spark, sf_dir):
    """Two lookups by priority, one row each, without what is excluded, the first few."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("post_id"), F.col("url").alias("link"), F.lit("").alias("title"))
    both = pages.filter("post_id % 3 = 0").withColumn("prio", F.lit(0)).union(pages.filter("post_id % 2 = 0").withColumn("prio", F.lit(1)))
    return posts.related_posts(both, pages.filter("post_id % 4 = 0").select("link"), [], 40).select(F.col("post_id").alias("id"), "link", "prio")


_LI = "'<li><a href=\"' || l || '\">' || t || '</a></li>'"
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "v8_related_html",
    f"""WITH p AS (SELECT n_regionkey AS region, n_nationkey AS k, {_ESC("n_name || ' & more'")} AS t, 'https://x.com/' || CAST(n_nationkey AS VARCHAR) AS l, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
    SELECT region, '<h2>مطالب مرتبط</h2>' || chr(10) || '<ul>' || chr(10) || string_agg({_LI}, chr(10) ORDER BY k) || chr(10) || '</ul>' AS html FROM p WHERE r <= 4 GROUP BY region""",
)
def v8(spark, sf_dir):
    """Nations as posts related to their region: the older markup."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", F.concat("n_name", F.lit(" & more")).alias("title"), F.concat(F.lit("https://x.com/"), F.col("n_nationkey").cast("string")).alias("link")).alias("x"))
    lists = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("x")).alias("found"))
    return lists.select("region", posts.related_html(F.col("found")).alias("html"))


@query(
    "s15_existing_drafts",
    """WITH d AS (SELECT 'k' || CAST(o_custkey AS VARCHAR) AS draft_key, 's' || CAST(min(o_orderkey) AS VARCHAR) AS slug FROM orders GROUP BY o_custkey), p AS (SELECT o_orderkey AS post_id, 's' || CAST(o_orderkey AS VARCHAR) AS slug, CASE WHEN o_orderkey % 7 = 0 THEN 'k' || CAST(o_custkey AS VARCHAR) END AS own FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0),
    f AS (SELECT draft_key, post_id FROM d JOIN p USING (slug) UNION ALL SELECT draft_key, post_id FROM d JOIN p ON own = draft_key) SELECT draft_key, min(post_id) AS post_id FROM f GROUP BY draft_key""",
)
def s15(spark, sf_dir):
    """Posts that drafts have already, by slug or by the key in their text."""
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("k"), F.col("o_custkey").cast("string"))
    drafts = o.groupBy(key.alias("draft_key")).agg(F.min("o_orderkey").alias("k")).select("draft_key", F.concat(F.lit("s"), F.col("k").cast("string")).alias("slug"))
    content = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('<div data-draft-key="'), key, F.lit('">x</div>')))
    published = o.filter("o_orderkey % 3 = 0 OR o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("post_id"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slug"), content.alias("content"))
    return posts.existing_drafts(drafts, published)


# pages of parts by loose key: names as they are; tags in another spelling
@query(
    "j4_localization",
    """WITH d AS (SELECT lower(p_name) AS key, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1), t AS (SELECT p_partkey AS id, 0 AS pos, lower(p_brand) AS key FROM part UNION ALL SELECT p_partkey, 1, lower(p_name) FROM part)
    SELECT id, arg_min(name, pos) AS name FROM t JOIN d USING (key) GROUP BY id""",
)
def j4(spark, sf_dir):
    """The first of an item's tags that has a page; case, accents, marks and punctuation do not count."""
    p = table(spark, sf_dir, "part")
    pages = p.withColumn("key", udfs.match_key(F.col("p_name"))).groupBy("key").agg(F.min_by(F.struct(F.col("p_name").alias("name"), F.lit("u").alias("url"), F.lit("a").alias("anchor")), "p_partkey").alias("p")).select("key", "p.*")
    tags = p.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(F.col("p_brand"), F.concat(F.lit("®"), F.upper(F.replace("p_name", F.lit(" "), F.lit(" - "))), F.lit("!")))).alias("pos", "tag"))
    return readers.localization_of(tags, pages).select("id", "name")


# caches of orders: a cache file is an order's, asked for by customers
@query(
    "s12_cached_analyses",
    f"""WITH c AS (SELECT 'game ' || CAST(o_custkey AS VARCHAR) AS game, 'https://x.com/r/' || CAST(o_orderkey AS VARCHAR) AS url, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT o_orderkey AS id, CASE WHEN c.k IS NULL THEN 'miss' WHEN c.k % 5 = 0 OR c.k % 7 = 0 THEN 'invalid' ELSE 'hit' END AS cache_status FROM orders LEFT JOIN c ON c.k = o_orderkey AND {s_cache_url('c.url')} = 'https://x.com/r/' || CAST(o_orderkey AS VARCHAR)""",
)
def s12(spark, sf_dir):
    """Cache files by game, platform and address; those of another version, or without a section, are invalid."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    point = "array(named_struct('point_fa', 'p', 'evidence_en', 'e', 'evidence_id', cast(null as string)))"
    none = "cast(null as array<struct<point_fa:string,evidence_en:string,evidence_id:string>>)"
    analysis = F.struct(
        F.lit("s").alias("site_name"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("original_score"), F.lit(None).cast("double").alias("review_score_10"),
        F.expr(point).alias("positives"), F.when(F.col("o_orderkey") % 7 == 0, F.expr(none)).otherwise(F.expr(point)).alias("negatives"), F.expr(point).alias("technical_notes"),
    )
    cache = o.filter("o_orderkey % 3 <> 0").select(
        F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise("v2").alias("cache_version"), F.lit("2024").alias("created_at_utc"), F.concat(F.lit("GAME  "), F.col("o_custkey").cast("string")).alias("game"), F.lit("pc").alias("platform"),
        F.concat(F.lit("HTTPS://X.com//r/"), key, F.lit("/?utm_source=1")).alias("requested_url"), analysis.alias("analysis"), F.lit(None).cast("string").alias("refresh_meta"),
    )
    jobs = o.select(F.concat(F.lit("game "), F.col("o_custkey").cast("string")).alias("game"), F.lit("PC").alias("platform"), F.concat(F.lit("https://x.com/r/"), key).alias("url"))
    return readers.cached_analyses(cache, jobs, "v2").select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("id"), "cache_status")


@query("q16_pending_without_cooldown", f"SELECT source_name, id, published_ts FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY coalesce(published_ts, 0) DESC, created_at DESC, id) AS r FROM {ITEMS_SQL} WHERE status = 'pending') WHERE r = 1")
def q16(spark, sf_dir):
    """The first generation's choice: an item that cools down is taken, too."""
    return state.next_pending(items(spark, sf_dir), None).select("source_name", "id", "published_ts")


@query("j2_windowed_duplicates")
def j2_windowed(spark, sf_dir):
    """Titles like a recent one: each new item's best match among the posted and skipped items of its own window, the hours before it."""
    titled = items(spark, sf_dir).withColumn("title_norm", F.concat_ws(" ", "title_norm", F.lit("alpha beta gamma delta"), "source_name"))
    new = titled.filter("status = 'pending'").select("id", "title_norm", F.coalesce("published_ts", F.lit(0)).alias("published_ts"))
    return similarity.windowed_duplicates(new, state.finished(titled), state.WINDOW_HOURS).select("id", "best_id", F.round("score", 9).alias("score"))


KNOBS = Rows("id int, name string, value string", [(1, "FEED_ENTRIES_LIMIT", "0"), (2, "AUTO_TAGS_MAX", "99"), (3, "DEDUP_SIM_THRESHOLD", "x"), (4, "DEDUP_SIM_THRESHOLD", " 0.9 "), (5, "AUTO_TAGS", "no"), (6, "POST_STATUS", "publish"), (7, "POST_STATUS", " ")])


@query(
    "s18_settings",
    f"""SELECT id, CASE name WHEN 'FEED_ENTRIES_LIMIT' THEN CAST(least(greatest(TRY_CAST(value AS INTEGER), 1), 100) AS VARCHAR) WHEN 'AUTO_TAGS_MAX' THEN CAST(least(greatest(TRY_CAST(value AS INTEGER), 0), 5) AS VARCHAR)
    WHEN 'DEDUP_SIM_THRESHOLD' THEN CAST(coalesce(TRY_CAST(trim(value) AS DOUBLE), 0.8) AS VARCHAR) WHEN 'AUTO_TAGS' THEN CASE WHEN lower(value) IN ('1', 'true', 'yes', 'on') THEN 'True' ELSE 'False' END ELSE coalesce(nullif(trim(value), ''), 'draft') END AS shown FROM {KNOBS.sql()}""",
)
def s18(spark, sf_dir):
    rows = [(k, settings.report(settings.read({name: value}))[name.lower()]) for k, name, value in KNOBS.rows]
    return spark.createDataFrame(rows, "id int, shown string")


# --- variants of older generations ----------------------------------------------------------------


@query(
    "v6_keyword_categories",
    f"""WITH t AS (SELECT doc_id, lower(coalesce(string_split(text, chr(10))[1], '')) AS t, lower(coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')) AS x FROM documents)
    SELECT doc_id, {{x}} AS by_text, {{t}} AS by_title FROM t""".format(
        **{c: "CASE " + " ".join(f"WHEN len(list_filter([{names(words)}], lambda w: contains({c}, w))) > 0 THEN '{kind}'" for kind, words in V.KEYWORD_CATEGORIES.items()) + " ELSE 'general' END" for c in ("x", "t")}
    ),
)
def v6(spark, sf_dir):
    """Kinds by plain keywords, of title and text, and of the title alone as for manual links."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce(F.split("text", "\n")[0], F.lit(""))).alias("title"), F.lower(text.blank(F.col("text"))).alias("body"))
    return d.select("doc_id", text.keyword_type(F.concat_ws(" ", "title", "body")).alias("by_text"), text.keyword_type(F.col("title")).alias("by_title"))


PAYLOADS = Rows(
    "id int, title_fa string, meta_title_fa string, meta_description_fa string, focus_keyword_fa string, content_html_fa string",
    [(1, "abc", "m" * 80, "d" * 200, "kw", "<p>" + "واژه " * 30 + "</p>"), (2, "ab", "meta", "desc", "k", "x" * 30), (3, " abc ", "meta", "desc", "kw", "short"), (4, None, None, None, None, None), (5, "abc", "meta", "desc", "kw", "<p>" + "word " * 400 + "</p>")],
)
_FIELDS = [("title_fa", 3), ("meta_title_fa", 3), ("meta_description_fa", 3), ("focus_keyword_fa", 2), ("content_html_fa", 20)]
_COUNT = "len(list_filter(regexp_extract_all(" + s_clean("content_html_fa") + ", '[\\p{L}\\p{N}_\\x{600}-\\x{6FF}]+'), lambda w: length(w) > 1))"


@query(
    "v11_older_payload_gate",
    f"""SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN length(trim(coalesce({c}, ''))) < {n} THEN '{c}' END" for c, n in _FIELDS)}, CASE WHEN {_COUNT} < 300 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS errors,
    left(trim(coalesce(meta_title_fa, '')), 70) AS meta_title, left(trim(coalesce(meta_description_fa, '')), 160) AS meta_description FROM {PAYLOADS.sql()}""",
)
def v11(spark, sf_dir):
    """The second generation's gate: required fields, cut ones, and a least number of words."""
    p = PAYLOADS.df(spark)
    return p.select("id", F.array_join(text.payload_errors(dict(_FIELDS), "content_html_fa", 300), ",").alias("errors"), F.substring(F.trim(text.blank(F.col("meta_title_fa"))), 1, 70).alias("meta_title"), F.substring(F.trim(text.blank(F.col("meta_description_fa"))), 1, 160).alias("meta_description"))


CREATED = Rows("id int, s string", [(1, "2026-07-06T00:09:01.123456"), (2, "2026-07-06T00:09:01+00:00"), (3, "2026-07-06T03:09:01+03:00"), (4, "2026-07-06 00:09:01"), (5, "later"), (6, None)])


@query(
    "v13_created_at",
    f"SELECT id, CAST(CASE id WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE epoch(TIMESTAMP '2026-07-06 00:09:01') END AS BIGINT) AS created FROM {CREATED.sql()}",
)
def v13(spark, sf_dir):
    """Times with and without an offset, which is UTC then, in one order."""
    return CREATED.df(spark).select("id", F.unix_seconds(dates.created_at(F.col("s"))).alias("created"))


FRAGMENTS = Rows("id int, s string", [(1, "<p>a <b onclick='x'>b</b></p><ul><li>c</li></ul>"), (2, "plain"), (3, "")])


@query(
    "v14_raw_blocks",
    f"""SELECT id, CASE id WHEN 1 THEN '<!-- wp:paragraph -->' || chr(10) || '<p>a <b onclick=''x''>b</b></p>' || chr(10) || '<!-- /wp:paragraph -->' || chr(10) || chr(10) || '<!-- wp:list -->' || chr(10) || '<ul class="wp-block-list">' || chr(10) || '<!-- wp:list-item -->' || chr(10) || '<li>c</li>' || chr(10) || '<!-- /wp:list-item -->' || chr(10) || '</ul>' || chr(10) || '<!-- /wp:list -->'
    WHEN 2 THEN '<!-- wp:paragraph -->' || chr(10) || '<p>plain</p>' || chr(10) || '<!-- /wp:paragraph -->' ELSE '' END AS blocks FROM {FRAGMENTS.sql()}""",
)
def v14(spark, sf_dir):
    """Blocks of the first generation, whose inline markup stays as it is."""
    return FRAGMENTS.df(spark).select("id", blocks.article(F.col("s"), sanitize=False).alias("blocks"))


IMAGES = Rows("id int, path string, length bigint", [(1, "a/x.jpg", 10), (2, "a/x.svg", 10), (3, "a/x.png", 0), (4, "a/x", 10)])


@query("v15_image_checks", f"SELECT id, ext IN ('jpg', 'png', '') AND length > 0 AS now, length > 0 AS older FROM (SELECT id, length, lower(regexp_extract(path, '\\.([A-Za-z0-9]{{2,5}})$', 1)) AS ext FROM {IMAGES.sql()})")
def v15(spark, sf_dir):
    """Image gates of today, and of the second generation, which only asked for content."""
    f = IMAGES.df(spark)
    now = readers.accepted_images(f.withColumn("content", F.lit(b"GIF"))).select("path", F.col("accepted").alias("now"))
    return f.join(now, "path").select("id", "now", (F.col("length") > 0).alias("older"))


@query("v16_post_payloads", "SELECT p_partkey, p_name AS title, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 85) AS slug, left(repeat(p_type || ' ', 30), 300) AS excerpt, p_partkey % 3 = 0 AS has_media FROM part")
def v16(spark, sf_dir):
    """What the second generation posted: a slug of its own, and an excerpt of 300 characters."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.repeat(F.concat("p_type", F.lit(" ")), F.lit(30)).alias("body"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("media"))
    made = text.post_payload(F.col("p_name"), F.col("body"), F.col("media"))
    return p.select("p_partkey", made["title"].alias("title"), made["slug"].alias("slug"), made["excerpt"].alias("excerpt"), made["featured_media"].isNotNull().alias("has_media"))


@query("v17_image_names", "SELECT p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 75) || '.jpg' AS older FROM part")
def v17(spark, sf_dir):
    """File names of the second generation: a cut slug, no suffix of their own."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.substring(slug, 1, 75), F.lit(".jpg")).alias("older"))


@query("u14_image_names", "SELECT p_partkey, regexp_replace(left(s, 60), '-+$', '') || '-' || left(regexp_extract(f, '([^-]*)$', 1), 6) || '.png' AS name FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s, 'img-' || md5(p_name) AS f FROM part)")
def u14(spark, sf_dir):
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "part").select("p_partkey", url.image_filename(slug, F.concat(F.lit("img-"), F.md5("p_name")), F.lit(".png")).alias("name"))


BATCH = Rows("line_no int, url string, outcome string", [(1, "https://a.com/1", "posted"), (2, "https://b.com/2", "failed"), (3, "https://c.com/3", "skipped"), (4, "https://d.com/4", None), (5, "https://b.com/2", "posted")])


@query("st5_retained_links", f"SELECT min(line_no) AS line_no, url FROM {BATCH.sql()} GROUP BY url HAVING count(*) FILTER (outcome IN ('posted', 'skipped')) = 0")
def st5(spark, sf_dir):
    """Links that stay after a manual batch: all but those that were posted or skipped."""
    b = BATCH.df(spark)
    done = b.filter(F.col("outcome").isin("posted", "skipped")).select("url").distinct()
    return ordered.ordered_distinct(b.join(done, "url", "left_anti"), "url", "line_no").select("line_no", "url")



REPLIES = Rows("id int, status int, method string, attempt int, body string", [(1, 503, "get", 0, ""), (2, 503, "POST", 0, ""), (3, 415, "GET", 3, ""), (4, 429, "GET", 4, ""), (5, 200, "GET", 0, '{"id": 3}'), (6, 404, "HEAD", 1, '{"id": 3}'), (7, 200, "GET", 0, "<html>")])


@query(
    "st9_retries",
    f"""SELECT id, status IN (415, 429, 500, 502, 503, 504) AND upper(method) IN ('GET', 'HEAD', 'OPTIONS') AND attempt < 4 AS again, status IN (429, 500, 502, 503, 504) AND upper(method) IN ('GET', 'HEAD', 'OPTIONS') AND attempt < 4 AS older,
    CASE WHEN attempt <= 1 THEN 0.0 ELSE pow(2.0, attempt - 1) END AS wait, status < 400 AND id = 5 AS healthy, 'Basic ' || to_base64(encode('u:' || CAST(id AS VARCHAR))) AS auth FROM {REPLIES.sql()}""",
)
def st9(spark, sf_dir):
    """Which replies are tried again, now and by the first generations, after how long, and whose health is good."""
    s, m, n = F.col("status"), F.col("method"), F.col("attempt")
    return REPLIES.df(spark).select(
        "id", http.tried_again(s, m, n).alias("again"), http.tried_again(s, m, n, statuses=http.OLDER_RETRY_STATUS).alias("older"), http.wait_seconds(n).alias("wait"), http.healthy(s, F.col("body")).alias("healthy"), http.basic_auth(F.lit("u"), F.col("id").cast("string")).alias("auth"),
    )


@query(
    "k5_seo_meta",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 3 END AS n_fields, 'title ' || CAST(length(p_name) AS VARCHAR) || ' chars | description ' || CAST(length(p_type) AS VARCHAR) || ' chars | keyword ' || CASE WHEN p_size % 3 = 0 THEN '-' ELSE p_brand END || ' | ' || CAST(p_size % 5 AS VARCHAR) || ' links' AS line FROM part",
)
def k5(spark, sf_dir):
    """Search metadata of posts, and the line of the log about it."""
    p = table(spark, sf_dir, "part")
    keyword = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    return p.select("p_partkey", F.size(sinks.seo_meta(F.col("p_name"), F.col("p_type"), keyword)).alias("n_fields"), sinks.seo_summary(F.col("p_name"), F.col("p_type"), keyword, F.col("p_size") % 5).alias("line"))


@query("st7_runtime_audits")
def st7(spark, sf_dir):
    """Audits of points after manual ones were laid over them: the cache itself stays as it is."""
    from newsloom.operators import evidence

    from .review import KEYS, POINTS

    points = POINTS.df(spark).withColumn("cache_url", F.lit("https://x.com/r"))
    manual = POINTS.df(spark).filter("game = 'A'").select("game", F.lit("").alias("platform"), F.lit("https://x.com/r").alias("cache_url"), F.lit("yes").alias("reviewed"), "section", "pos", "point_fa", F.concat(F.lit("Added by hand: "), "evidence_en").alias("evidence_en"))
    added = evidence.overlay(points, manual).drop("cache_url")
    return evidence.audit(POINTS.df(spark).unionByName(added), [*KEYS, "source_no"]).select(*KEYS, "source_no", "verified_points", "status")
