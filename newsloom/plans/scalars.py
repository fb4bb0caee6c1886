"""Queries of URL, text, date and score operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates, scores, text, udfs, url
from newsloom.functions import vocabulary as V

from .base import (
    Rows,
    literal,
    names,
    query,
    s_cache_url,
    s_canonical,
    s_clean,
    s_clean_unescaped,
    s_collapse,
    s_host,
    s_identity,
    s_netloc,
    s_path,
    s_scheme,
    s_score,
    s_title,
    s_tokens,
    s_trim,
    s_unescape,
    table,
)

#: pages' urls, and a re-spelled copy of each
SPELLED = """(SELECT page_id, url FROM pages UNION ALL
  SELECT page_id + 1000000, replace(url, '://', '://WWW.') || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_medium=Mail&b=2&a=x+y' ELSE '/?UTM_Source=q&b=&a=%7Ez' END FROM pages)"""


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    extra = F.when(F.contains(u, F.lit("#")), "").when(F.contains(u, F.lit("?")), "&utm_medium=Mail&b=2&a=x+y").otherwise("/?UTM_Source=q&b=&a=%7Ez")
    return pages.union(pages.select(F.col("page_id") + 1000000, F.concat(F.replace(u, F.lit("://"), F.lit("://WWW.")), extra)))


@query("u1_canonical_url", f"SELECT page_id, {s_canonical('url')} AS canonical, sha256({s_canonical('url')}) AS id FROM {SPELLED}")
def u1(spark, sf_dir):
    return spelled(spark, sf_dir).select("page_id", url.canonical(F.col("url")).alias("canonical"), url.url_hash(F.col("url")).alias("id"))


@query(
    "u3_cache_url",
    f"SELECT page_id, {s_cache_url('url')} AS cache_url, sha256(concat_ws('|', 'v1', lower({s_clean_unescaped(literal('Some  Game'))}), 'pc', {s_cache_url('url')})) AS cache_key FROM {SPELLED}",
)
def u3(spark, sf_dir):
    u = F.col("url")
    return spelled(spark, sf_dir).select("page_id", url.cache_url(u).alias("cache_url"), url.cache_key("v1", F.lit("Some  Game"), F.lit("PC"), u).alias("cache_key"))


@query(
    "u5_url_identity",
    f"""SELECT page_id, {s_identity('url')} AS identity, regexp_replace(regexp_replace({s_host('url')}, '\\.+$', ''), '^www\\.', '') AS site_host,
    {s_scheme('url')} IN ('http', 'https') AND {s_netloc('url')} <> '' AS valid,
    regexp_replace({s_host('url')}, '^www\\.', '') = 'thther.example.org' AS internal FROM {SPELLED}""",
)
def u5(spark, sf_dir):
    u = F.col("url")
    return spelled(spark, sf_dir).select("page_id", url.identity(u).alias("identity"), url.site_host(u).alias("site_host"), url.is_valid(u).alias("valid"), url.is_internal(u, "https://www.thther.example.org/").alias("internal"))


HOSTS = Rows(
    "id int, u string",
    [(k, u) for k, u in enumerate(["https://www.ign.com/a", "https://uk.ign.com/b", "https://GamesRadar.com", "https://example.org/x", "https://metro.co.uk/z", "http://a.b.metro.co.uk:80/", "notaurl", "https://user@www.Site.tv/p", "https://notign.com/", "https://blog.example.co.uk", ""])],
)
_DISPLAY = "|".join(s.replace(".", "\\.") for s in V.DISPLAY_SUFFIXES)


@query(
    "u8_site_names",
    f"""WITH h AS (SELECT id, u, {s_host('u')} AS host FROM {HOSTS.sql()}), n AS (SELECT *, regexp_replace(host, '^www\\.', '') AS bare FROM h)
    SELECT id, coalesce(nullif(regexp_replace(bare, '\\.({"|".join(V.HOST_SUFFIXES)})$', ''), ''), 'Unknown Source') AS fallback_name,
    coalesce(nullif({s_trim(f"regexp_replace({s_clean('bare')}, '(?i)\\.(?:{_DISPLAY})\\s*$', '')")}, ''), 'Source') AS display_name,
    (SELECT d.name FROM (VALUES {", ".join(f"({literal(k)}, {literal(v)})" for k, v in V.SITE_NAMES.items())}) AS d(domain, name) WHERE n.bare = d.domain OR ends_with(n.bare, '.' || d.domain)) AS known_name FROM n""",
)
def u8(spark, sf_dir):
    u = F.col("u")
    return HOSTS.df(spark).select("id", url.fallback_site_name(u).alias("fallback_name"), url.display_name_from_url(u).alias("display_name"), url.reputable_name(u).alias("known_name"))


@query(
    "u10_title_from_url",
    f"""SELECT page_id, coalesce(nullif({s_clean(s_trim("translate(regexp_replace(coalesce(nullif(CASE WHEN p <> '' THEN list_extract(string_split(regexp_replace(p, '^/+|/+$', '', 'g'), '/'), -1) ELSE n END, ''), n), '(?i)\\.[a-z0-9]{3,4}$', ''), '-_', '  ')"))}, ''), nullif({s_clean('n')}, ''), 'News') AS title
    FROM (SELECT page_id, {s_path('url')} AS p, {s_netloc('url')} AS n FROM {SPELLED})""",
)
def u10(spark, sf_dir):
    return spelled(spark, sf_dir).select("page_id", url.title_from_url(F.col("url")).alias("title"))


IMAGES = Rows(
    "id int, u string, srcset string",
    [
        (1, "https://x.com/a/Logo.png", "a.jpg 100w, b.jpg 300w, c.jpg 300w"), (2, "https://x.com/a/hero.png?logo=1", "a.jpg, b.jpg 2x"), (3, "", ""), (4, None, None),
        (5, "https://x.com/no-image/x.jpg", " big.webp 1200w , small.webp 400w"), (6, "https://x.com/x.jpg", "only.jpg"),
    ],
)
_REJECT = "|".join(w.replace(".", "\\.") for w in V.IMAGE_REJECT_WORDS)


@query(
    "u12_images",
    f"""WITH c AS (SELECT id, u, list_filter(list_transform(string_split(coalesce(srcset, ''), ','), lambda p: regexp_split_to_array({s_trim('p')}, '\\s+')), lambda p: p[1] <> '') AS cs FROM {IMAGES.sql()}),
    w AS (SELECT id, u, list_transform(cs, lambda p, i: {{'w': coalesce(TRY_CAST(regexp_extract(coalesce(p[2], ''), '^(\\d+)w$', 1) AS BIGINT), 0), 'i': i, 'url': p[1]}}) AS ws FROM c)
    SELECT id, coalesce(u, '') <> '' AND NOT regexp_matches(lower({s_path("coalesce(u, '')")}), '{_REJECT}') AS usable, coalesce(list_max(ws).url, '') AS largest FROM w""",
)
def u12(spark, sf_dir):
    return IMAGES.df(spark).select("id", url.is_article_image(F.col("u")).alias("usable"), url.largest_srcset(F.col("srcset")).alias("largest"))


#: the first line of each document stands for a title
FIRST_LINE = "string_split(text, chr(10))[1]"


def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split("text", "\n")[0].alias("title"), "text")


@query("t1_clean_text", f"SELECT page_id, md5({s_clean('html')}) AS cleaned, md5({s_clean_unescaped('html')}) AS unescaped FROM pages")
def t1(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_text(h)).alias("cleaned"), F.md5(text.clean_unescaped(h)).alias("unescaped"))


@query(
    "t3_titles",
    f"SELECT doc_id, norm, len({s_tokens('norm')}) AS n_tokens, array_to_string({s_tokens('norm')}[1:6], ' ') AS keywords FROM (SELECT doc_id, {s_title(FIRST_LINE)} AS norm FROM documents)",
)
def t3(spark, sf_dir):
    norm = titles(spark, sf_dir).select("doc_id", "title", text.normalize_title(F.col("title")).alias("norm"))
    return norm.select("doc_id", "norm", F.size(text.tokens(F.col("norm"))).alias("n_tokens"), text.search_keywords(F.col("title")).alias("keywords"))


@query(
    "t5_title_jaccard",
    f"""WITH t AS (SELECT doc_id, list_distinct({s_tokens(s_title(FIRST_LINE))}) AS k FROM documents)
    SELECT a.doc_id AS doc_id, CASE WHEN len(a.k) > 0 AND len(b.k) > 0 THEN round(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))), 9) ELSE 0.0 END AS jaccard
    FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""",
)
def t5(spark, sf_dir):
    t = titles(spark, sf_dir).select("doc_id", text.tokens(text.normalize_title(F.col("title"))).alias("k"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("other"))
    return t.join(other, "doc_id").select("doc_id", F.round(text.jaccard(F.col("k"), F.col("other")), 9).alias("jaccard"))


_SLUG_BASE = f"regexp_replace(regexp_replace(lower({s_clean(f'''regexp_replace(strip_accents({FIRST_LINE}), '[^\\x00-\\x7F]', '', 'g')''')}), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
_SLUG = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace({_SLUG_BASE}, '\\b(?:later |earlier )?this (?:year|month|week)\\b', ' ', 'g'), ' +'), lambda w: w <> '' AND w NOT IN ({names(V.SLUG_STOPWORDS)}))[1:7], '-')"


@query(
    "t8_latin_slugs",
    f"SELECT doc_id, regexp_replace(CASE WHEN length(slug) > 75 THEN coalesce(nullif(regexp_replace(left(slug, 75), '-[^-]*$', ''), ''), left(slug, 75)) ELSE slug END, '^-+|-+$', '', 'g') AS slug FROM (SELECT doc_id, {_SLUG} AS slug FROM documents WHERE lang IN ('en', 'fr'))",
)
def t8(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", udfs.ascii_fold(F.split("text", "\n")[0]).alias("folded"))
    return rows.select("doc_id", text.latin_slug(F.col("folded")).alias("slug"))


GAMES = Rows("id int, name string", [(k, x) for k, x in enumerate(["Ghost Recon: Wildlands", "ghost recon wildlands", "Ghost of Yōtei™", "Pokémon® Legends", "Assassin's Creed", "Ōkami &amp; Friends", None, "", "  A  B "])])


@query(
    "t9_match_keys",
    f"SELECT id, trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace({s_unescape('''coalesce(name, '')''')}, '[™®©''’`]', '', 'g'))), '[^0-9a-z]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM {GAMES.sql()}",
)
def t9(spark, sf_dir):
    return GAMES.df(spark).select("id", udfs.match_key(F.col("name")).alias("key"))


TAGS = Rows(
    "id int, tags array<string>",
    [(1, ["GTA VI", "Rockstar Games", "gta vi", "news", "2024"]), (2, ["- Elden Ring:", "DLC", "x", "Baldur’s Gate 3", "Baldur's Gate 3", "A", "B c", "D e", "F g", "H i"]), (3, []), (4, ["<b>Half-Life</b>", "Half-Life", "R&amp;D"]), (5, [None, "   ", "PC"])],
)
_KEY = s_collapse(f"regexp_replace(regexp_replace(lower({s_clean(s_unescape('''coalesce(t, '')'''))}), '[‘’‚‛`´]', '''', 'g'), '[^0-9a-z\\x{{600}}-\\x{{6ff}}+&'' -]+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


@query(
    "t15_entity_tags",
    f"""WITH e AS (SELECT id, CAST(pos AS BIGINT) AS pos, regexp_replace({s_clean('raw')}, '^[ \\-–—:;,.]+|[ \\-–—:;,.]+$', '', 'g') AS t FROM (SELECT id, unnest(tags) AS raw, generate_subscripts(tags, 1) AS pos FROM {TAGS.sql()})),
    k AS (SELECT id, pos, t, {_KEY} AS key FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY pos) AS rn FROM k WHERE length(t) BETWEEN 2 AND 80 AND length(key) >= 2 AND key NOT IN ({names(V.GENERIC_TAGS)}) AND NOT regexp_full_match(key, '[0-9]+')),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM f WHERE rn = 1)
    SELECT s.id AS id, coalesce(string_agg(n.t, '|' ORDER BY n.pos), '') AS tags FROM {TAGS.sql()} s LEFT JOIN n ON n.id = s.id AND n.r <= 5 GROUP BY s.id""",
)
def t15(spark, sf_dir):
    return TAGS.df(spark).select("id", F.array_join(text.entity_tags(F.col("tags")), "|").alias("tags"))


STORIES = Rows(
    "id int, title string, snippet string, page string",
    [
        (1, "Nvidia RTX 5090 GPU launch", "graphics card", ""), (2, "Elden Ring DLC trailer", "new expansion", "steam"), (3, "Starfield review", "", ""), (4, "Markets today", "nothing", "at all"),
        (5, "A handheld on Steam", "benchmark preview", "gpu cpu ram"), (6, None, "game", None), (7, "PS5 controller", "", "hands-on impressions"), (8, "Laptop display", "", ""),
    ],
)


def _sql_type(words: dict, rows: str, key: str, title: str, snippet: str, page: str) -> str:
    return f"""WITH c AS (SELECT {key}, lower(coalesce({title}, '')) AS h, lower(coalesce({title}, '')) || ' ' || lower(coalesce({snippet}, '')) || ' ' || left(lower(coalesce({page}, '')), 5000) AS x FROM {rows}),
    p AS (SELECT {key}, {s_score('h', words['review'])} AS rh, {s_score('x', words['review'])} AS rx, 3 * {s_score('h', words['hardware'])} + {s_score('x', words['hardware'])} AS hw, 3 * {s_score('h', words['gaming'])} + {s_score('x', words['gaming'])} AS gm FROM c)
    SELECT {key}, CASE WHEN rh > 0 OR rx >= 2 THEN 'review' WHEN hw > 0 AND hw > gm THEN 'hardware' WHEN gm > 0 THEN 'gaming' WHEN hw > 0 THEN 'hardware' ELSE 'general' END AS content_type FROM p"""


_WORDS = {"review": V.REVIEW_PATTERNS, "hardware": V.HARDWARE_PATTERNS, "gaming": V.GAMING_PATTERNS}
#: words of the synthetic documents, so that every branch is met at scale
_INVENTED = {"review": [" license", " qui "], "hardware": [" der ", " und ", " the "], "gaming": [" of ", " and ", " que "]}


@query("t12_content_type", _sql_type(_WORDS, STORIES.sql(), "id", "title", "snippet", "page"))
def t12(spark, sf_dir):
    return STORIES.df(spark).select("id", text.infer_content_type(F.col("title"), F.col("snippet"), F.col("page")).alias("content_type"))


@query("t12_content_type_documents", _sql_type(_INVENTED, "documents", "doc_id", FIRST_LINE, "lang", "text"))
def t12_documents(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", text.infer_content_type(F.col("title"), F.col("lang"), F.col("text"), _INVENTED).alias("content_type"))


KINDS = Rows("id int, raw string, fallback string", [(1, "Games", "general"), (2, " tech ", "general"), (3, "Review", "x"), (4, "??", "gaming"), (5, None, "nope"), (6, "hardware", "general"), (7, "", "review")])
_IDS = {"all": 1, "reviews": 22, "hardware": 33, "gaming": 44, "default": 9}


@query(
    "t13_categories",
    f"""WITH v AS (SELECT id, fallback, lower({s_clean('raw')}) AS c FROM {KINDS.sql()}), a AS (SELECT id, fallback, CASE c {" ".join(f"WHEN {literal(k)} THEN {literal(x)}" for k, x in V.CONTENT_TYPE_ALIASES.items())} ELSE c END AS c FROM v),
    n AS (SELECT id, CASE WHEN c IN ({names(V.CONTENT_TYPES)}) THEN c WHEN fallback IN ({names(V.CONTENT_TYPES)}) THEN fallback ELSE 'general' END AS content_type FROM a)
    SELECT id, content_type, CASE content_type WHEN 'review' THEN '22' WHEN 'hardware' THEN '1,33' WHEN 'gaming' THEN '1,44' ELSE '1' END AS categories FROM n""",
)
def t13(spark, sf_dir):
    kinds = KINDS.df(spark).select("id", text.normalize_content_type(F.col("raw"), F.col("fallback")).alias("content_type"))
    return kinds.select("id", "content_type", F.array_join(text.pick_categories(F.col("content_type"), _IDS), ",").alias("categories"))


DATES = Rows(
    "id int, s string",
    [(k, x) for k, x in enumerate(["Mon, 06 Jul 2026 00:09:01 +0000", "Tue, 7 Jul 2026 23:30:00 -0530", "06 Jan 2025 10:00 GMT", "2026-07-06T00:09:01Z", "2025-02-28", "soon + later", "", None, "Fri, 31 Dec 2027 12:00:00 EST"])],
)
_M = "(?:[A-Za-z]{3,9},?\\s+)?(\\d{1,2} [A-Za-z]{3} \\d{4}) (\\d{1,2}:\\d{2})(:\\d{2})?\\s*(\\S*)$"


def _dates_sql(months: list[str]) -> str:
    return f"""WITH p AS (SELECT id, trim(coalesce(s, '')) AS s, regexp_extract(trim(coalesce(s, '')), '^{_M}', 1) AS d, regexp_extract(trim(coalesce(s, '')), '^{_M}', 2) AS t, coalesce(nullif(regexp_extract(trim(coalesce(s, '')), '^{_M}', 3), ''), ':00') AS sec, regexp_extract(trim(coalesce(s, '')), '^{_M}', 4) AS z FROM {DATES.sql()}),
    q AS (SELECT *, TRY_STRPTIME(nullif(d, '') || ' ' || t || sec, '%d %b %Y %H:%M:%S') AS local, CASE WHEN z IN ('', 'GMT') THEN 0 WHEN z = 'EST' THEN -18000 ELSE (CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 3600 + CAST(substr(z, 4, 2) AS INTEGER) * 60) END AS off FROM p),
    r AS (SELECT *, coalesce(local, TRY_STRPTIME(regexp_extract(s, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:[T ].*)?$', 1), '%Y-%m-%d')) AS shown FROM q)
    SELECT id, CAST(coalesce(CAST(epoch(local) AS BIGINT) - off, 1700000000) AS BIGINT) AS published_ts,
    CASE WHEN s = '' THEN '' WHEN shown IS NOT NULL THEN day(shown) || ' ' || list_extract([{names(months)}], CAST(month(shown) AS INTEGER)) || ' ' || year(shown) ELSE trim(split_part(s, '+', 1)) END AS shown FROM r"""


@query("d1_dates", _dates_sql(V.MONTHS_FA))
def d1(spark, sf_dir):
    s = F.col("s")
    return DATES.df(spark).select("id", dates.published_ts(s, F.timestamp_seconds(F.lit(1700000000))).alias("published_ts"), dates.display_date(s).alias("shown"))


@query("v18_older_dates", f"SELECT id, shown FROM ({_dates_sql(V.OLDER_MONTHS_FA)}) UNION ALL SELECT 100, '6 جوئن 2026'")
def v18(spark, sf_dir):
    """Dates with the month names of the first generations."""
    june = spark.createDataFrame([(100, "2026-06-06")], "id int, s string")
    return DATES.df(spark).union(june).select("id", dates.display_date(F.col("s"), V.OLDER_MONTHS_FA).alias("shown"))


SCALES = Rows(
    "id int, v string, best string, worst string",
    [(1, "4", "5", None), (2, "80", "100", "0"), (3, "8.5", None, None), (4, "88", None, None), (5, "101", None, None), (6, "x", "10", None), (7, "1,000", "2000", None), (8, "6", "10", "1"), (9, "12", "10", None), (10, None, None, None), (11, "-1", None, None), (12, "7", "bad", "bad")],
)


@query(
    "m1_score_to_10",
    f"""WITH n AS (SELECT id, TRY_CAST(replace(trim(v), ',', '') AS DOUBLE) AS v, TRY_CAST(replace(trim(best), ',', '') AS DOUBLE) AS b, coalesce(TRY_CAST(replace(trim(worst), ',', '') AS DOUBLE), 0.0) AS w FROM {SCALES.sql()}),
    s AS (SELECT id, v, CASE WHEN b > w THEN (v - w) / (b - w) * 10 WHEN v BETWEEN 0 AND 10 THEN v WHEN v BETWEEN 0 AND 100 THEN v / 10 END AS s FROM n)
    SELECT id, CASE WHEN s BETWEEN 0 AND 10 THEN round_even(s, 1) END AS score_10, CASE WHEN trunc(v) BETWEEN 0 AND 100 THEN trunc(v) END AS score_100 FROM s""",
)
def m1(spark, sf_dir):
    return SCALES.df(spark).select("id", scores.to_10(F.col("v"), F.col("best"), F.col("worst")).alias("score_10"), scores.as_100(F.col("v")).cast("double").alias("score_100"))


@query(
    "m3_halves",
    """WITH p AS (SELECT p_partkey, p_retailprice / 200 AS x, CAST(p_size AS DOUBLE) / 4 AS y FROM part)
    SELECT p_partkey, floor((least(greatest(x, 1.0), 10.0) + 1e-9) * 2) / 2 AS floored, round_even(least(greatest(y, 1.0), 10.0) * 2, 0) / 2 AS rounded, CAST(p_partkey * 100 + 40 AS BIGINT) AS rank FROM p""",
)
def m3(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 200).alias("x"), (F.col("p_size").cast("double") / 4).alias("y"))
    return p.select("p_partkey", scores.floor_to_half(F.col("x")).alias("floored"), scores.round_to_half(F.col("y")).alias("rounded"), scores.quality_rank(F.col("p_partkey"), F.lit(2), F.lit(0)).cast("bigint").alias("rank"))


SHOWN = Rows("id int, raw string, best string", [(1, "8", "10"), (2, "85", None), (3, "9.5", "0"), (4, "", "10"), (5, "A+", None), (6, "4", "5"), (7, None, None)])


@query(
    "m5_display",
    f"SELECT id, CASE WHEN r = '' THEN '' WHEN b <> '' AND b NOT IN ('0', '0.0') THEN r || '/' || b WHEN TRY_CAST(r AS DOUBLE) IS NULL THEN r WHEN TRY_CAST(r AS DOUBLE) <= 10 THEN r || '/10' ELSE r || '/100' END AS shown FROM (SELECT id, trim(coalesce(raw, '')) AS r, trim(coalesce(best, '')) AS b FROM {SHOWN.sql()})",
)
def m5(spark, sf_dir):
    return SHOWN.df(spark).select("id", scores.display(F.col("raw"), F.col("best")).alias("shown"))


TYPES = Rows("id int, ct string", [(1, "image/png"), (2, "IMAGE/JPEG"), (3, "image/webp; q=1"), (4, "image/avif"), (5, None), (6, "image/gif")])


@query("m8_mime", f"SELECT id, CASE WHEN contains(c, 'png') THEN 'png' WHEN contains(c, 'webp') THEN 'webp' WHEN contains(c, 'gif') THEN 'gif' WHEN contains(c, 'jpeg') OR contains(c, 'jpg') THEN 'jpg' END AS ext FROM (SELECT id, lower(coalesce(ct, '')) AS c FROM {TYPES.sql()})")
def m8(spark, sf_dir):
    return TYPES.df(spark).select("id", url.image_type(F.col("ct")).alias("ext"))


STATUS = Rows("id int, s string", [(1, ""), (2, "Early Access"), (3, "early-access"), (4, "Remastered"), (5, "DLC"), (6, "beta"), (7, None), (8, " GOTY ")])


@query(
    "t26_game_status",
    f"SELECT id, CASE WHEN v = '' THEN 'released' ELSE coalesce(CASE lower(v) {' '.join(f'WHEN {literal(k)} THEN {literal(x)}' for k, x in V.GAME_STATUS_ALIASES.items())} END, 'custom') END AS status FROM (SELECT id, {s_clean_unescaped('s')} AS v FROM {STATUS.sql()})",
)
def t26(spark, sf_dir):
    return STATUS.df(spark).select("id", text.game_status(F.col("s")).alias("status"))


@query("t23_numbers", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'))) AS n_numbers FROM documents")
def t23(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.numbers(F.col("text"))).cast("bigint").alias("n_numbers"))
