"""Text columns: cleaning, titles, slugs, keys, pattern scores, sentences. All are Column -> Column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"
"""White space of any script: Java's ``\\s`` is ASCII only."""

#: the entities that markup is full of; others go through ``udfs.unescape``
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def or_null(c: Column) -> Column:
    """Null for an empty text: ``coalesce(or_null(a), b)`` prefers a non-empty a."""
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def unescape_common(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_text(c: Column) -> Column:
    """Tags to spaces, white space to one space, trimmed; entities stay."""
    return collapse(F.regexp_replace(blank(c), "<[^>]+>", " "))


def clean_unescaped(c: Column) -> Column:
    """As ``clean_text`` after entities are resolved, so that escaped tags go, too."""
    return clean_text(unescape_common(blank(c)))


def normalize_title(c: Column) -> Column:
    """Lower-case words of three letters or more without stop words, at most 220 characters."""
    words = F.split(collapse(F.regexp_replace(F.lower(blank(c)), r"[^a-z0-9\s]", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(V.TITLE_STOPWORDS))
    return F.trim(F.substring(F.array_join(kept, " "), 1, 220))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(F.trim(blank(norm)), " "), lambda w: w != "")


def search_keywords(title: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(tokens(normalize_title(title)), 1, n), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard; 0 if a side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def latin_slug(folded: Column, max_words: int = 7, max_len: int = 75) -> Column:
    """A slug of a text that is plain ASCII already (see ``udfs.ascii_fold``)."""
    base = F.regexp_replace(F.lower(clean_text(folded)), "['’`]", "")
    base = F.regexp_replace(base, "[^a-z0-9]+", " ")
    base = F.regexp_replace(base, r"\b(?:later |earlier )?this (?:year|month|week)\b", " ")
    words = F.filter(F.split(base, " +"), lambda w: (w != "") & ~w.isin(V.SLUG_STOPWORDS))
    slug = F.array_join(F.slice(words, 1, max_words), "-")
    head = F.substring(slug, 1, max_len)
    cut = F.coalesce(or_null(F.regexp_replace(head, "-[^-]*$", "")), head)
    return F.regexp_replace(F.when(F.length(slug) > max_len, cut).otherwise(slug), "^-+|-+$", "")


def tag_key(c: Column) -> Column:
    value = F.lower(clean_text(unescape_common(blank(c))))
    value = F.regexp_replace(value, "[‘’‚‛`´]", "'")
    return collapse(F.regexp_replace(value, "[^0-9a-z؀-ۿ+&' -]+", " "))


def entity_tags(values: Column, max_tags: int = 5) -> Column:
    """Clean tags, distinct by key in their order, the first ``max_tags``."""
    edge = "[ \\-–—:;,.]"
    named = F.transform(values, lambda v: F.regexp_replace(clean_text(v), f"^{edge}+|{edge}+$", ""))
    keyed = F.transform(named, lambda t: F.struct(t.alias("tag"), tag_key(t).alias("key")))
    fit = F.filter(
        keyed,
        lambda x: F.length(x["tag"]).between(2, 80) & (F.length(x["key"]) >= 2) & ~x["key"].isin(V.GENERIC_TAGS) & ~x["key"].rlike("^[0-9]+$"),
    )
    first = F.aggregate(
        fit,
        F.array().cast("array<struct<tag:string,key:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.slice(F.transform(first, lambda x: x["tag"]), 1, max_tags)


def any_pattern(patterns: Sequence[str]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike(any_pattern(patterns))


def pattern_score(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match."""
    return F.size(F.filter(F.array(*(F.lit("(?i)" + p) for p in patterns)), lambda p: F.rlike(c, p)))


def infer_content_type(title: Column, snippet: Column, page: Column, vocabulary: dict[str, Sequence[str]] | None = None) -> Column:
    words = vocabulary or {"review": V.REVIEW_PATTERNS, "hardware": V.HARDWARE_PATTERNS, "gaming": V.GAMING_PATTERNS}
    head = F.lower(blank(title))
    context = F.concat_ws(" ", head, F.lower(blank(snippet)), F.substring(F.lower(blank(page)), 1, 5000))
    hardware = pattern_score(head, words["hardware"]) * 3 + pattern_score(context, words["hardware"])
    gaming = pattern_score(head, words["gaming"]) * 3 + pattern_score(context, words["gaming"])
    return (
        F.when((pattern_score(head, words["review"]) > 0) | (pattern_score(context, words["review"]) >= 2), "review")
        .when((hardware > 0) & (hardware > gaming), "hardware")
        .when(gaming > 0, "gaming")
        .when(hardware > 0, "hardware")
        .otherwise("general")
    )


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def normalize_content_type(c: Column, fallback: Column) -> Column:
    value = F.lower(clean_text(c))
    value = F.coalesce(lookup(value, V.CONTENT_TYPE_ALIASES), value)
    return F.when(value.isin(V.CONTENT_TYPES), value).when(fallback.isin(V.CONTENT_TYPES), fallback).otherwise("general")


def pick_categories(content_type: Column, ids: dict[str, int]) -> Column:
    """Category ids of a content type; ``ids`` has all, reviews, hardware, gaming and default, 0 for none."""
    base = [ids["all"]] if ids["all"] else []
    fallback = base or ([ids["default"]] if ids["default"] > 0 else [])
    arr = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<int>")
    out = F.when(F.lit(False), arr([]))
    if ids["reviews"]:
        out = out.when(content_type == "review", arr([ids["reviews"]]))
    for kind in ("hardware", "gaming"):
        if ids[kind]:
            out = out.when(content_type == kind, arr([*base, ids[kind]]))
    return out.otherwise(arr(fallback))


def evidence_word_count(c: Column) -> Column:
    return F.regexp_count(clean_unescaped(c), F.lit(r"(?U)\b[\w'-]+\b"))


def broken(c: Column) -> Column:
    return F.contains(blank(c), F.lit("�"))


def ordered_distinct(values: Column, key=lambda x: x, limit: int | None = None) -> Column:
    """The first of each key, in order, ``limit`` at most. One walk over the values, which are evaluated once."""
    none = F.array().cast("array<string>")

    def add(kept: Column, x: Column) -> Column:
        known = F.array_contains(kept["keys"], key(x))
        if limit is not None:
            known = known | (F.size(kept["keys"]) >= limit)
        more = F.struct(F.array_append(kept["keys"], key(x)).alias("keys"), F.array_append(kept["found"], x).alias("found"))
        return F.when(known, kept).otherwise(more)

    return F.aggregate(values, F.struct(none.alias("keys"), none.alias("found")), add, lambda kept: kept["found"])


def evidence_sentences(c: Column, low: int = 8, high: int = 26, limit: int | None = None) -> Column:
    """Quotable sentences in order: 8 to 26 words, first of each by lower case, the first ``limit``."""
    parts = F.split(clean_unescaped(c), rf"(?<=[.!?]){SPACE}+|(?<=;){SPACE}+")
    named = F.transform(parts, lambda s: F.regexp_replace(clean_unescaped(s), "^[ \\-–—]+|[ \\-–—]+$", ""))
    kept = F.filter(named, lambda s: (s != "") & ~broken(s) & F.regexp_count(s, F.lit(r"(?U)\b[\w'-]+\b")).between(low, high))
    return ordered_distinct(kept, F.lower, limit)


def numbers(c: Column) -> Column:
    """Distinct numbers of a text, Persian digits read as ASCII."""
    return F.array_distinct(F.regexp_extract_all(F.translate(blank(c), "۰۱۲۳۴۵۶۷۸۹", "0123456789"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def claim_compatible(claim: Column, quote: Column) -> Column:
    """Whether a claim's terms are borne out by its quote."""
    fa, en = clean_unescaped(claim), F.lower(clean_unescaped(quote))
    out = (fa != "") & ~broken(fa) & ~broken(en)
    for terms, patterns in V.CLAIM_DOMAINS:
        out = out & (~fa.rlike("|".join(re.escape(t) for t in terms)) | matches_any(en, patterns))
    return out


def classify_evidence(quote: Column, section: Column) -> Column:
    """struct<category, sentiment>; both null where no category, or an unknown section."""
    text, part = clean_unescaped(quote), F.lower(clean_unescaped(section))
    category = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, patterns in V.CATEGORY_PATTERNS.items():
        category = category.when(matches_any(text, patterns), F.lit(name))
    sentiment = (
        F.when(part == "positives", "positive")
        .when(part == "negatives", "negative")
        .when(part == "technical_notes", F.when(matches_any(text, V.TECHNICAL_NEGATIVE_PATTERNS), "negative").when(matches_any(text, V.TECHNICAL_POSITIVE_PATTERNS), "positive").otherwise("neutral"))
    )
    known = category.isNotNull() & sentiment.isNotNull()
    return F.struct(F.when(known, category).alias("category"), F.when(known, sentiment).alias("sentiment"))


def game_status(c: Column) -> Column:
    value = clean_unescaped(c)
    return F.when(value == "", "released").otherwise(F.coalesce(lookup(F.lower(value), V.GAME_STATUS_ALIASES), F.lit("custom")))


def is_true(c: Column) -> Column:
    return F.lower(F.trim(blank(c))).isin(V.TRUE_WORDS)


def keyword_type(c: Column) -> Column:
    """The second generation's kind of a text in lower case: the first group of keywords that it contains."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in V.KEYWORD_CATEGORIES.items():
        out = out.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(c, w)), kind)
    return out.otherwise("general")


def persian_word_count(c: Column) -> Column:
    """Words of two characters or more of cleaned text: what Python's [\\w\\u0600-\\u06FF]+ finds."""
    words = F.regexp_extract_all(clean_text(c), F.lit(r"([\p{L}\p{N}_\u0600-\u06FF]+)"), F.lit(1))
    return F.size(F.filter(words, lambda w: F.length(w) > 1))


def payload_errors(least: dict[str, int], body: str, min_words: int = 0) -> Column:
    """Names of required columns that are shorter than they must be, and ``short`` for a body of too few words."""
    found = [F.when(F.length(F.trim(blank(F.col(c)))) < n, c) for c, n in least.items()]
    return F.array_compact(F.array(*found, F.when(persian_word_count(F.col(body)) < min_words, "short")))


def post_payload(title: Column, body: Column, media: Column) -> Column:
    """struct<title, content, slug, excerpt, featured_media> of a post; no excerpt is longer than 300 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.struct(title.alias("title"), body.alias("content"), F.substring(slug, 1, 85).alias("slug"), F.substring(body, 1, 300).alias("excerpt"), media.alias("featured_media"))


def short_list(values: Column, limit: int = 4) -> Column:
    """Clean values, each once, the first ``limit``; a null list is empty."""
    named = F.filter(F.transform(values, lambda v: clean_unescaped(v)), lambda v: v != "")
    return F.coalesce(F.slice(F.array_distinct(named), 1, limit), F.array().cast("array<string>"))
