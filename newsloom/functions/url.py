"""URL columns: parts, canonical forms, identities, names. All are Column -> Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import blank, clean_text, or_null, trim

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(trim(blank(u)), _SCHEME, 1))


def _rest(u: Column) -> Column:
    return F.regexp_replace(trim(blank(u)), _SCHEME, "")


def netloc(u: Column) -> Column:
    return F.regexp_extract(_rest(u), r"^//([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(u), r"^//[^/?#]*", ""), r"^([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(_rest(u), r"^[^?#]*\?([^#]*)", 1)


def host(u: Column) -> Column:
    """Lower-case host name without user or port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(u), r"^.*@", ""), r":\d*$", ""))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical(u: Column) -> Column:
    """Lower scheme and host, no tracking parameters, sorted parameters, no trailing slash or fragment."""
    pairs = F.transform(
        F.filter(F.split(query(u), "&"), lambda x: x != ""),
        lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(V.TRACKING_PARAMETERS)))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    where = F.coalesce(or_null(F.regexp_replace(path(u), "/+$", "")), F.lit("/"))
    return F.concat(
        F.when(scheme(u) != "", F.concat(scheme(u), F.lit(":"))).otherwise(""),
        F.when(netloc(u) != "", F.concat(F.lit("//"), F.lower(netloc(u)))).otherwise(""),
        where,
        F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(""),
    )


def url_hash(u: Column) -> Column:
    return F.sha2(canonical(u), 256)


def cache_url(u: Column) -> Column:
    """Scheme (https if none), host, path with single slashes; no query or fragment."""
    where = F.regexp_replace(F.coalesce(or_null(path(u)), F.lit("/")), "/+", "/")
    return F.concat(F.coalesce(or_null(scheme(u)), F.lit("https")), F.lit("://"), F.lower(netloc(u)), F.when(where == "/", where).otherwise(F.regexp_replace(where, "/+$", "")))


def cache_key(version: str, game: Column, platform: Column, u: Column) -> Column:
    from .text import clean_unescaped

    return F.sha2(F.concat_ws("|", F.lit(version), F.lower(clean_unescaped(game)), F.lower(clean_unescaped(platform)), cache_url(u)), 256)


def identity(u: Column) -> Column:
    """Host without www. and path without trailing slash, lower case."""
    return F.lower(F.concat(F.regexp_replace(F.lower(netloc(u)), r"^www\.", ""), F.regexp_replace(path(u), "/+$", "")))


def site_host(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host(u), r"\.+$", ""), r"^www\.", "")


def is_internal(u: Column, base: str) -> Column:
    site = site_host(F.lit(base))
    return (site != "") & (site_host(u) == site)


def is_valid(u: Column) -> Column:
    return scheme(u).isin("http", "https") & (netloc(u) != "")


def fallback_site_name(u: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host(u), r"^www\.", ""), r"\.(" + "|".join(V.HOST_SUFFIXES) + ")$", "")
    return F.coalesce(or_null(name), F.lit("Unknown Source"))


def display_name(c: Column) -> Column:
    return trim(F.regexp_replace(clean_text(c), r"(?i)\.(?:" + "|".join(re.escape(s) for s in V.DISPLAY_SUFFIXES) + r")\s*$", ""))


def display_name_from_url(u: Column) -> Column:
    return F.coalesce(or_null(display_name(F.regexp_replace(host(u), r"^www\.", ""))), F.lit("Source"))


def reputable_name(u: Column) -> Column:
    """The known name of a host, or of a domain that it ends in; null if neither. One map lookup a suffix."""
    names = F.create_map(*(F.lit(x) for kv in V.SITE_NAMES.items() for x in kv))
    labels = F.split(F.regexp_replace(host(u), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.try_element_at(F.filter(F.transform(suffixes, lambda s: names[s]), lambda n: n.isNotNull()), F.lit(1))


def title_from_url(u: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path(u), "^/+|/+$", ""), "/"), -1)
    slug = F.coalesce(or_null(F.when(path(u) != "", last).otherwise(netloc(u))), netloc(u))
    slug = F.regexp_replace(slug, r"(?i)\.[a-z0-9]{3,4}$", "")
    slug = trim(F.translate(slug, "-_", "  "))
    return F.coalesce(or_null(clean_text(slug)), or_null(clean_text(netloc(u))), F.lit("News"))


def is_article_image(u: Column) -> Column:
    return (blank(u) != "") & ~F.lower(path(u)).rlike("|".join(re.escape(w) for w in V.IMAGE_REJECT_WORDS))


def largest_srcset(c: Column) -> Column:
    """The candidate with the greatest width; of equal ones the last; no descriptor counts as 0."""
    pieces = F.filter(F.transform(F.split(blank(c), ","), lambda p: F.split(trim(p), r"\s+")), lambda p: p[0] != "")
    found = F.transform(
        pieces,
        lambda p, i: F.struct(F.when(F.size(p) > 1, F.coalesce(F.regexp_extract(F.get(p, F.lit(1)), r"^(\d+)w$", 1).try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("width"), i.alias("at"), p[0].alias("url")),
    )
    return F.coalesce(F.array_max(found)["url"], F.lit(""))


def image_filename(slug: Column, fallback: Column, ext: Column) -> Column:
    kind = F.regexp_replace(F.coalesce(or_null(blank(ext)), F.lit("jpg")), r"^\.+", "")
    suffix = F.substring(F.substring_index(fallback, "-", -1), 1, 6)
    return F.when(slug != "", F.concat(F.regexp_replace(F.substring(slug, 1, 60), "-+$", ""), F.lit("-"), suffix, F.lit("."), kind)).otherwise(F.concat(fallback, F.lit("."), kind))


def image_type(content_type: Column, older: bool = False) -> Column:
    """Extension of an image's content type; null for one that can't be shown, which the first generation called jpg."""
    c = F.lower(blank(content_type))
    has = lambda w: F.contains(c, F.lit(w))
    found = F.when(has("png"), "png").when(has("webp"), "webp").when(has("gif"), "gif").when(has("jpeg") | has("jpg"), "jpg")
    return found.otherwise("jpg") if older else found
