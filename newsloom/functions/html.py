"""HTML columns: visible text, titles, dates, metadata, embedded JSON. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udfs
from .text import SPACE, blank, clean_text, collapse, or_null, trim, unescape_common
from .url import largest_srcset

_Q, _NQ = "[\"']", "[^\"']+"


def _meta(key: str, names: str) -> list[str]:
    """Patterns of a meta tag's content, for both orders of its attributes."""
    return [
        rf"(?is)<meta[^>]+{key}={_Q}{names}{_Q}[^>]+content={_Q}({_NQ}){_Q}",
        rf"(?is)<meta[^>]+content={_Q}({_NQ}){_Q}[^>]+{key}={_Q}{names}{_Q}",
    ]


TITLE_PATTERNS = [*_meta("(?:property|name)", "(?:og:title|twitter:title)"), r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"]
SITE_NAME_PATTERNS = [*_meta("(?:property|name)", "og:site_name"), *_meta("name", "application-name")]
PUBLISHED_PATTERNS = [
    _meta("property", "article:published_time")[0],
    _meta("property", "og:published_time")[0],
    _meta("name", "pubdate")[0],
    rf"(?is)<time[^>]+datetime={_Q}({_NQ}){_Q}",
    r'(?is)"datePublished"\s*:\s*"([^"]+)"',
]
INVISIBLE = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>", r"(?s)<!--.*?-->"]


def _first_of(html: Column, patterns: list[str], finish) -> Column:
    return F.coalesce(*(or_null(finish(F.regexp_extract(blank(html), p, 1))) for p in patterns), F.lit(""))


def title(html: Column) -> Column:
    return _first_of(html, TITLE_PATTERNS, lambda x: clean_text(unescape_common(x)))


def site_name(html: Column) -> Column:
    return _first_of(html, SITE_NAME_PATTERNS, lambda x: clean_text(unescape_common(x)))


def published_at(html: Column, older: bool = False) -> Column:
    """``older``: without the JSON-LD branch, which never matched in the first generation."""
    return _first_of(html, PUBLISHED_PATTERNS[:-1] if older else PUBLISHED_PATTERNS, trim)


def visible_text(html: Column, limit: int = 15_000) -> Column:
    raw = blank(html)
    for pattern in INVISIBLE:
        raw = F.regexp_replace(raw, pattern, " ")
    text = collapse(unescape_common(F.regexp_replace(raw, "(?s)<[^>]+>", " ")))
    text = F.regexp_replace(text, rf"(?i)\b(read more|continue reading|see more|learn more)\b{SPACE}*[›>]+", " ")
    text = F.regexp_replace(text, rf"{SPACE}*[›>]+{SPACE}*", " ")
    return F.substring(collapse(text), 1, limit)


def article_text(html: Column) -> Column:
    raw = F.regexp_replace(F.regexp_replace(blank(html), INVISIBLE[0], " "), INVISIBLE[1], " ")
    return collapse(unescape_common(F.regexp_replace(raw, "(?s)<[^>]+>", " ")))


def article_words(html: Column) -> Column:
    return F.regexp_count(article_text(html), F.lit("[A-Za-z0-9؀-ۿ]+"))


def article_paragraphs(html: Column) -> Column:
    return F.regexp_count(blank(html), F.lit(r"(?is)<p\b[^>]*>\s*.*?\s*</p>"))


def article_errors(html: Column, min_words: int = 300, min_paragraphs: int = 3) -> Column:
    raw, plain = trim(blank(html)), article_text(html)
    found = F.array(
        F.when(article_words(html) < min_words, "too short"),
        F.when(article_paragraphs(html) < min_paragraphs, "too few paragraphs"),
        F.when(F.endswith(raw, F.lit("<")) | F.endswith(plain, F.lit("<")), "dangling <"),
        F.when((plain != "") & ~F.right(plain, F.lit(1)).isin(*".!؟?…\"'»”’)"), "no ending punctuation"),
    )
    return F.array_compact(found)


def tidy_article(html: Column) -> Column:
    """Without a dangling ``<`` and without phrases that send the reader to the source."""
    return trim(F.regexp_replace(trim(F.regexp_replace(trim(blank(html)), r"\s*<\s*$", "")), r"(?imU)\b(برای اطلاعات بیشتر.*|جزئیات بیشتر.*|در منبع.*)\b", ""))


def main_html(html: Column) -> Column:
    """The longest article body, else the longest main body, else all."""
    raw = blank(html)

    def longest(tag: str) -> Column:
        found = F.regexp_extract_all(raw, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
        ranked = F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("body")))
        return F.array_max(ranked)["body"]

    return F.coalesce(longest("article"), longest("main"), raw)


def json_ld(html: Column) -> Column:
    """The embedded JSON-LD documents that parse, as text, in order."""
    found = F.regexp_extract_all(blank(html), F.lit(rf"(?is)<script\b[^>]*type={_Q}application/ld\+json{_Q}[^>]*>(.*?)</script>"), F.lit(1))
    texts = F.transform(found, lambda x: trim(unescape_common(x)))
    return F.filter(texts, lambda x: (x != "") & F.try_parse_json(x).isNotNull())


def json_object(c: Column) -> Column:
    """The JSON of a reply as text: all of it, or from its first brace to its last; null if neither parses."""
    text = trim(blank(c))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parsed(text), parsed(inner))


# --- pages by their tags: a page is split into tags and text by one pattern, and the lists are worked on as columns ---

TAG = r"<[A-Za-z/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
_UNSEEN_TAGS = "script|style|noscript|svg|iframe|canvas|template|form"


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's text, quoted or not; empty if it has none."""
    found = [F.regexp_extract(tag, rf"(?is)[\s/\"']{name}\s*=\s*{p}", 1) for p in (r"\"([^\"]*)\"", r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*(or_null(x) for x in found), F.lit(""))


def tags(html: Column, names: str) -> Column:
    return F.regexp_extract_all(blank(html), F.lit(rf"(?is)(<(?:{names})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)"), F.lit(1))


def page_title(html: Column) -> Column:
    return udfs.unescape(collapse(F.regexp_extract(blank(html), r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)", 1)))


def page_meta(html: Column) -> Column:
    """map<string, string>: contents of meta tags by property, name or itemprop, in lower case; the first of each counts."""
    named = lambda t: F.lower(trim(F.coalesce(*(or_null(attribute(t, k)) for k in ("property", "name", "itemprop")), F.lit(""))))
    kept = F.filter(tags(html, "meta"), lambda t: (named(t) != "") & (trim(attribute(t, "content")) != ""))
    keys = F.transform(kept, named)
    values = udfs.unescape_each(F.transform(kept, lambda t: trim(attribute(t, "content"))))
    first = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda x, at: F.array_position(keys, x["key"]) == at + 1)
    return F.map_from_entries(first)


def page_text(html: Column) -> Column:
    """The text outside of scripts, forms and other elements that are not read, entities resolved."""
    raw = F.regexp_replace(F.regexp_replace(blank(html), r"(?s)<!--.*?(?:-->|\z)", ""), rf"(?is)<({_UNSEEN_TAGS})\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    return collapse(udfs.unescape(F.regexp_replace(raw, f"(?s){TAG}", " ")))


#: fixed values: names under which pages declare an image, and attributes of images that load late, in order of preference
_DECLARED = [("property", ["og:image", "og:image:url", "og:image:secure_url"]), ("name", ["twitter:image", "twitter:image:src"])]
_LAZY = ["data-src", "data-lazy-src", "data-original", "data-flickity-lazyload", "src"]


def image_candidates(html: Column) -> Column:
    """Image references of a page in order of preference, as written: those it declares, then those after its headline."""
    metas = tags(html, "meta")
    declared = [
        F.coalesce(F.try_element_at(F.transform(F.filter(metas, lambda t: F.lower(attribute(t, key)).isin(names) & (trim(attribute(t, "content")) != "")), lambda t: trim(attribute(t, "content"))), F.lit(1)), F.lit(""))  # noqa: B023
        for key, names in _DECLARED
    ]
    after = F.regexp_extract(blank(html), r"(?is)</h1\s*>(.*)", 1)
    each = F.transform(tags(after, "img|source"), lambda t: F.array(largest_srcset(attribute(t, "data-srcset")), largest_srcset(attribute(t, "srcset")), *(attribute(t, k) for k in _LAZY)))
    every = udfs.unescape_each(F.transform(F.concat(F.array(*declared), F.flatten(each)), trim))
    return F.array_distinct(F.filter(every, lambda x: (x != "") & ~F.lower(x).rlike("^(?:data|javascript):")))


INLINE = ["b", "strong", "i", "em", "u", "a"]


def escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def sanitize_inline(html: Column) -> Column:
    """Inline formatting only, all else as escaped text; links keep http(s) targets.

    The fragment is split into tags and text. A tag is looked up in the list of those allowed and written
    anew from its name, so nothing else of it gets through; text has its entities resolved and is escaped.
    """
    pieces = inline_pieces(html)
    return sanitized(pieces, udfs.unescape_each(pieces))


def inline_pieces(html: Column) -> Column:
    """Tags and texts of a fragment, in order, without comments."""
    return F.regexp_extract_all(F.regexp_replace(blank(html), r"(?s)<!--.*?-->", ""), F.lit(rf"(?s)({TAG}|[^<]+|<)"), F.lit(1))


def sanitized(pieces: Column, plain: Column) -> Column:
    """``inline_pieces`` written anew; ``plain``: the same with entities resolved."""
    is_tag = lambda x: x.rlike(rf"(?s)^{TAG}$")

    def written(x: Column, resolved: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][^\s/>]*)", 1))
        target = trim(attribute(resolved, "href"))
        opened = F.when((name == "a") & F.lower(target).rlike("^https?://"), F.concat(F.lit('<a href="'), escape(target), F.lit('" target="_blank" rel="nofollow noopener">'))).otherwise(F.concat(F.lit("<"), name, F.lit(">")))
        tag = F.when(~name.isin(INLINE) | (x.rlike(r"/\s*>$") & ~F.startswith(x, F.lit("</"))), "").when(F.startswith(x, F.lit("</")), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(opened)
        return F.when(is_tag(x), tag).otherwise(escape(resolved))

    return trim(F.array_join(F.zip_with(pieces, plain, written), ""))
