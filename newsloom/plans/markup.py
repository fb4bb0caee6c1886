"""Queries of HTML, JSON and rendering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import blocks, html, text, udfs, url

from .base import Rows, literal, names, query, s_clean, s_collapse, s_trim, s_unescape, table


def _first(patterns: list[str], finish, column: str = "html") -> str:
    return "coalesce(" + ", ".join(f"nullif({finish(f'regexp_extract({column}, {literal(p)}, 1)')}, '')" for p in patterns) + ", '')"


_CLEAN = lambda x: s_clean(s_unescape(x))


@query("h2_page_titles", f"SELECT page_id, {_first(html.TITLE_PATTERNS, _CLEAN)} AS title, {_first(html.SITE_NAME_PATTERNS, _CLEAN)} AS site_name, {_first(html.PUBLISHED_PATTERNS, s_trim)} AS published_at FROM pages")
def h2(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(h).alias("title"), html.site_name(h).alias("site_name"), html.published_at(h).alias("published_at"))


def _visible(x: str) -> str:
    for p in html.INVISIBLE:
        x = f"regexp_replace({x}, {literal(p)}, ' ', 'g')"
    x = s_collapse(s_unescape(f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"))
    x = f"regexp_replace({x}, '(?i)\\b(read more|continue reading|see more|learn more)\\b\\s*[›>]+', ' ', 'g')"
    return f"left({s_collapse(f'''regexp_replace({x}, '\\s*[›>]+\\s*', ' ', 'g')''')}, 15000)"


@query("h1_visible_text", f"SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, {_visible('html')} AS t FROM pages)")
def h1(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


_BODIES = "list_transform(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), lambda x, i: {'n': length(x), 'at': -i, 'body': x})"


@query("h8_main_html", f"SELECT page_id, md5(coalesce(list_max(b).body, html)) AS digest FROM (SELECT page_id, html, {_BODIES} AS b FROM pages)")
def h8(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.main_html(F.col("html"))).alias("digest"))


@query("h7_parsed_text")
def h7(spark, sf_dir):
    """Title, metadata and text of review pages."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(h).alias("title"), F.size(html.page_meta(h)).alias("n_meta"), F.length(html.page_text(h)).alias("n_chars"))


@query(
    "s7_page_records",
    f"SELECT page_id, {_first(html.TITLE_PATTERNS, _CLEAN)} AS title, CAST(length({_visible('html')}) AS INTEGER) AS text_chars, {_first(html.SITE_NAME_PATTERNS, _CLEAN)} AS site_name, {_first(html.PUBLISHED_PATTERNS, s_trim)} AS published_at, regexp_matches(url, '^https?://[^/?#]+') AS ok FROM pages",
)
def s7(spark, sf_dir):
    """One scan of a page, all its fields."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(h).alias("title"), F.length(html.visible_text(h)).alias("text_chars"), html.site_name(h).alias("site_name"), html.published_at(h).alias("published_at"), url.is_valid(F.col("url")).alias("ok"))


_ARTICLE = s_collapse(s_unescape("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"))


@query(
    "f2_article_quality",
    f"""WITH a AS (SELECT page_id, {s_trim('html')} AS raw, {_ARTICLE} AS plain, html FROM pages), c AS (SELECT *, len(regexp_extract_all(plain, '[A-Za-z0-9\\x{{600}}-\\x{{6ff}}]+')) AS words, len(regexp_extract_all(html, '(?is)<p\\b[^>]*>\\s*.*?\\s*</p>')) AS paragraphs FROM a)
    SELECT page_id, words, paragraphs, array_to_string(list_filter([CASE WHEN words < 300 THEN 'too short' END, CASE WHEN paragraphs < 3 THEN 'too few paragraphs' END, CASE WHEN raw LIKE '%<' OR plain LIKE '%<' THEN 'dangling <' END,
    CASE WHEN plain <> '' AND NOT contains('.!؟?…"''»”’)', right(plain, 1)) THEN 'no ending punctuation' END], lambda x: x IS NOT NULL), ',') AS errors FROM c""",
)
def f2(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", html.article_words(h).cast("bigint").alias("words"), html.article_paragraphs(h).cast("bigint").alias("paragraphs"), F.array_join(html.article_errors(h), ",").alias("errors")
    )


IMAGE_PAGES = Rows(
    "id int, html string",
    [
        (1, '<meta property="og:image" content="/a/hero.jpg"><h1>x</h1><img src="z.jpg">'), (2, '<meta property="og:image" content="/logo.png"><h1>x</h1><img src="data:x"><img data-src="lazy.jpg" src="tiny.gif">'),
        (3, '<img src="early.jpg"><h1>t</h1><source srcset="a.webp 100w, b.webp 900w">'), (4, "<p>none</p>"), (5, '<meta name="twitter:image" content="https://t.co/i.png">'),
    ],
)


@query("h5_article_images", "SELECT * FROM (VALUES (1, 'https://x.com/a/hero.jpg'), (2, 'https://x.com/p/lazy.jpg'), (3, 'https://x.com/p/b.webp'), (5, 'https://t.co/i.png')) AS t(id, image)")
def h5(spark, sf_dir):
    c = IMAGE_PAGES.df(spark).select("id", F.posexplode(html.image_candidates(F.col("html"))).alias("pos", "u"))
    usable = c.withColumn("u", udfs.join_url(F.lit("https://x.com/p/index.html"), F.col("u"))).filter(url.is_article_image(F.col("u")))
    return usable.groupBy("id").agg(F.min_by("u", "pos").alias("image"))


INLINE = Rows("id int, s string", [(1, "<b>x</b><script>y</script> & z"), (2, '<a href="https://x.com/?a=1&b=2" onclick="z">l</a>'), (3, '<a href="javascript:x">l</a><br/>t'), (4, "")])


# a fragment's pieces by DuckDB: cut at paragraphs and lists, tags looked up by name, text resolved and escaped
def _esc(x: str) -> str:
    for char, entity in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&quot;"), ("chr(39)", "&#x27;")):
        x = f"replace({x}, {char}, '{entity}')"
    return x


def _href(x: str) -> str:
    found = [f"nullif(regexp_extract({x}, {literal(p)}, 1), '')" for p in (r"""(?is)[\s/"']href\s*=\s*"([^"]*)\"""", r"""(?is)[\s/"']href\s*=\s*'([^']*)'""", r"""(?is)[\s/"']href\s*=\s*([^\s"'>]+)""")]
    return f"trim(coalesce({', '.join(found)}, ''))"


def s_sanitized(x: str) -> str:
    name, href = r"lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1))", _href(s_unescape("t"))
    opened = f"""CASE WHEN {name} = 'a' AND regexp_matches(lower({href}), '^https?://') THEN '<a href="' || {_esc(href)} || '" target="_blank" rel="nofollow noopener">' ELSE '<' || {name} || '>' END"""
    tag = rf"CASE WHEN {name} NOT IN ({names(html.INLINE)}) OR (regexp_matches(t, '/\s*>$') AND NOT starts_with(t, '</')) THEN '' WHEN starts_with(t, '</') THEN '</' || {name} || '>' ELSE {opened} END"
    pieces = f"regexp_extract_all(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), {literal(f'(?s){html.TAG}|[^<]+|<')})"
    return s_trim(f"array_to_string(list_transform({pieces}, lambda t: CASE WHEN regexp_matches(t, {literal(f'(?s)^{html.TAG}$')}) THEN {tag} ELSE {_esc(s_unescape('t'))} END), '')")


def _p(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN '<!-- wp:paragraph -->' || chr(10) || '<p>' || {x} || '</p>' || chr(10) || '<!-- /wp:paragraph -->' ELSE '' END"


@query("h9_sanitized", f"SELECT CAST(id AS BIGINT) AS id, md5(s) AS digest FROM (SELECT -id AS id, {s_sanitized('s')} AS s FROM {INLINE.sql()} UNION ALL SELECT page_id, {s_sanitized('html')} FROM pages)")
def h9(spark, sf_dir):
    """Inline formatting of odd fragments and of every page."""
    rows = INLINE.df(spark).select((-F.col("id")).cast("bigint").alias("id"), "s").union(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("id", F.md5(html.sanitize_inline(F.col("s"))).alias("digest"))


FRAGMENTS = Rows(
    "id int, s string",
    [
        (1, "<p>One &amp; <b>two</b></p><ul><li>a <script>x</script></li><li> </li><li><i>b</i></li></ul> tail <p></p>"), (2, "plain <b>text</b> & more"), (3, "<ul>no items</ul>"), (4, ""), (5, None),
        (6, '<p class="x"><a href="https://x.com/?a=1&amp;b=2" onclick="z">l</a> <a href=javascript:x>m</a><br/></p>between<p>z</p>'), (7, "<ul><li></li></ul>"),
    ],
)
_CUTS = f"string_split(regexp_replace(trim(coalesce(s, '')), {literal('(' + blocks.PIECE + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
_ITEMS = f"regexp_extract_all(inside, {literal(blocks.ITEM)}, 1)"
_LIST = "'<!-- wp:list -->' || chr(10) || '<ul class=\"wp-block-list\">' || chr(10) || array_to_string(list_transform(items, lambda i: '<!-- wp:list-item -->' || chr(10) || '<li>' || i || '</li>' || chr(10) || '<!-- /wp:list-item -->'), chr(10)) || chr(10) || '</ul>' || chr(10) || '<!-- /wp:list -->'"


@query(
    "h10_blocks",
    f"""WITH f AS (SELECT page_id AS id, html AS s FROM pages UNION ALL SELECT CAST(-id AS BIGINT), s FROM {FRAGMENTS.sql()}), c AS (SELECT id, s, unnest({_CUTS}) AS part, generate_subscripts({_CUTS}, 1) AS k FROM f),
    r AS (SELECT *, regexp_matches(part, '(?is)^<p\\b[^>]*>.*</p>$') AS is_p, regexp_matches(part, '(?is)^<ul\\b[^>]*>.*</ul>$') AS is_ul, regexp_extract(part, '(?is)^<(?:p|ul)\\b[^>]*>(.*)</(?:p|ul)>$', 1) AS inside FROM c WHERE part <> ''),
    w AS (SELECT *, {s_sanitized('inside')} AS inline, list_filter(list_transform({_ITEMS}, lambda i: {s_sanitized('i')}), lambda i: i <> '') AS items, len({_ITEMS}) AS n, {_esc(s_clean('inside'))} AS inside_text, {_esc(s_clean('part'))} AS part_text FROM r),
    b AS (SELECT id, k, CASE WHEN is_p THEN {_p('inline')} WHEN is_ul AND n = 0 THEN {_p('inside_text')} WHEN is_ul AND len(items) = 0 THEN '' WHEN is_ul THEN {_LIST} ELSE {_p('part_text')} END AS block FROM w),
    j AS (SELECT id, string_agg(block, chr(10) || chr(10) ORDER BY k) AS blocks FROM b WHERE block <> '' GROUP BY id), x AS (SELECT id, {_esc(s_clean('s'))} AS plain FROM f)
    SELECT x.id AS id, md5(coalesce(blocks, {_p('plain')})) AS digest FROM x LEFT JOIN j USING (id)""",
)
def h10(spark, sf_dir):
    """Every page, and fragments with lists, links and text between, as editor blocks."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("s")).union(FRAGMENTS.df(spark).select((-F.col("id")).cast("bigint"), "s"))
    return rows.select("id", F.md5(blocks.article(F.col("s"))).alias("digest"))


MARKDOWN = Rows("id int, s string", [(1, "# Title\n\n- **bold** [l](https://x.com)\n- two\n\n> q\n\n---\ntext *em*"), (2, "<div>\nraw\n</div>"), (3, "| a | b |\n|---|---|\n| c | d |")])


@query(
    "h11_markdown",
    "SELECT * FROM (VALUES (1, '<h2>Title</h2>' || chr(10) || '<ul><li><strong>bold</strong> <a href=\"https://x.com\">l</a></li><li>two</li></ul>' || chr(10) || '<blockquote><p>q</p></blockquote>' || chr(10) || '<hr>' || chr(10) || '<p>text <em>em</em></p>'), (2, '<div>' || chr(10) || '<p>raw</p>' || chr(10) || '</div>'), (3, '<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>')) AS t(id, html)",
)
def h11(spark, sf_dir):
    return MARKDOWN.df(spark).select("id", blocks.markdown(F.col("s")).alias("html"))


@query("h12_scorecard_numbers", "SELECT p_partkey, CASE WHEN s >= 9 THEN 'outstanding' WHEN s >= 8 THEN 'great' WHEN s >= 7 THEN 'good' WHEN s >= 5.5 THEN 'fair' ELSE 'weak' END AS tier, round(339.292 * (1 - s / 10), 3) AS ring_offset, round(s * 10, 1) AS bar_width FROM (SELECT p_partkey, CAST(p_size % 21 AS DOUBLE) / 2 AS s FROM part)")
def h12(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") % 21).cast("double") / 2).alias("s"))
    s = F.col("s")
    return p.select("p_partkey", blocks.tier(s).alias("tier"), blocks.ring_offset(s).alias("ring_offset"), blocks.bar_width(s).alias("bar_width"))


# --- JSON ---------------------------------------------------------------------------------------


@query("n1_json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def n1(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json(html.json_object(F.col("props"))), "$.k", "bigint").alias("k"), "event_type")


REPLIES = Rows("id int, s string", [(1, '{"a": 1}'), (2, 'Sure! {"a": 2} done'), (3, "no json"), (4, ""), (5, "{broken"), (6, '```json\n{"a": {"b": 6}}\n```')])


@query("n1_json_replies", "SELECT * FROM (VALUES (1, '{\"a\": 1}'), (2, '{\"a\": 2}'), (3, NULL), (4, NULL), (5, NULL), (6, '{\"a\": {\"b\": 6}}')) AS t(id, object)")
def n1_replies(spark, sf_dir):
    return REPLIES.df(spark).select("id", html.json_object(F.col("s")).alias("object"))


LD = Rows("id int, html string", [(1, '<script type="application/ld+json">{"x":1}</script><script type="application/ld+json">bad</script>'), (2, "<script>{}</script>"), (3, '<script id="q" type="application/ld+json"> [1,2] </script>')])


@query("n2_json_ld", "SELECT * FROM (VALUES (1, '{\"x\":1}', 1), (2, '', 0), (3, '[1,2]', 1)) AS t(id, documents, n)")
def n2(spark, sf_dir):
    docs = html.json_ld(F.col("html"))
    return LD.df(spark).select("id", F.array_join(docs, "|").alias("documents"), F.size(docs).alias("n"))


PAYLOADS = Rows("id int, title string, meta string, body string", [(1, "abc", "m" * 80, "x" * 30), (2, "a", "meta", "x" * 30), (3, "abcd", "", "short"), (4, None, None, None)])


@query(
    "n5_payload_gate",
    f"""SELECT id, array_to_string(list_filter([CASE WHEN length(trim(coalesce(title, ''))) < 3 THEN 'title' END, CASE WHEN length(trim(coalesce(meta, ''))) < 3 THEN 'meta' END, CASE WHEN length(trim(coalesce(body, ''))) < 20 THEN 'body' END], lambda x: x IS NOT NULL), ',') AS errors, left(trim(coalesce(meta, '')), 70) AS meta FROM {PAYLOADS.sql()}""",
)
def n5(spark, sf_dir):
    short = lambda c, n: F.when(F.length(F.trim(text.blank(F.col(c)))) < n, c)
    found = F.array_compact(F.array(short("title", 3), short("meta", 3), short("body", 20)))
    return PAYLOADS.df(spark).select("id", F.array_join(found, ",").alias("errors"), F.substring(F.trim(text.blank(F.col("meta"))), 1, 70).alias("meta"))


@query("m7_image_headers", "SELECT * FROM (VALUES (1, 800, 400), (2, 0, 0), (3, 10, 20)) AS t(id, width, height)")
def m7(spark, sf_dir):
    rows = [(1, b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (800).to_bytes(4, "big") + (400).to_bytes(4, "big")), (2, b"GIF89a"), (3, b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x0b\x08" + (20).to_bytes(2, "big") + (10).to_bytes(2, "big") + b"\0" * 8)]
    d = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "id int, data binary").select("id", udfs.image_dimensions(F.col("data")).alias("d"))
    return d.select("id", F.col("d.width").alias("width"), F.col("d.height").alias("height"))
