"""Readers of the inputs: feeds, link lists, source lists, queues, evidence caches, images."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import html, text, udfs, url

FEED = "link string, title string, summary string, description string, published string, pubDate string, updated string"
ATOM = "link array<struct<_href:string,_rel:string>>, title string, summary string, content string, published string, updated string"


def manual_links(lines: DataFrame) -> DataFrame:
    """(line_no, line) without blanks, comments and repetitions, as (line_no, url)."""
    cleaned = lines.select("line_no", text.trim(text.blank(F.col("line"))).alias("url"))
    return cleaned.filter((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).groupBy("url").agg(F.min("line_no").alias("line_no"))


def feed(spark: SparkSession, path: str, source_name: str, limit: int = 10) -> DataFrame:
    """The first entries of an RSS or Atom file; rows that do not parse are dropped, never raised.

    An Atom entry's link is that of its first link element that is no other relation.
    """
    rss = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(FEED).load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(ATOM).load(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    both = rss.withColumn("published", F.coalesce("published", "pubDate")).drop("pubDate").unionByName(
        atom.select(F.try_element_at(F.transform(own, lambda x: x["_href"]), F.lit(1)).alias("link"), "title", "summary", F.col("content").alias("description"), "published", "updated")
    )
    numbered = both.withColumn("pos", F.monotonically_increasing_id())
    return numbered.orderBy("pos").limit(max(1, limit)).select(F.lit(source_name).alias("source_name"), "pos", "link", "title", "summary", "description", "published", "updated")


def _mapping(spark: SparkSession, path: str) -> object:
    """A YAML or JSON file, read by Spark, so from wherever Spark reads; the YAML library is optional."""
    content = spark.read.option("wholetext", True).text(path).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(content)
    return yaml.safe_load(content)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(name, feed) of each source; both are required."""
    found = (_mapping(spark, path) or {}).get("sources")
    if not isinstance(found, list) or not found:
        raise ValueError("no sources")
    if any("name" not in s or "feed" not in s for s in found):
        raise ValueError("each source needs a name and a feed")
    return spark.createDataFrame([(str(s["name"]).strip(), str(s["feed"]).strip()) for s in found], "name string, feed string")


QUEUE = "pos int, game string, platform string, release_date string, game_status string, metacritic_url string, review_urls array<string>, refresh_evidence string, refresh_incomplete_evidence string"


def review_queue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each job of the queue, in order; a file without a list of reviews raises an error."""
    found = (_mapping(spark, path) or {}).get("reviews", [])
    if not isinstance(found, list):
        raise ValueError("reviews is no list")
    text_of = lambda job, k: None if job.get(k) is None else str(job[k])
    names = ("game", "platform", "release_date", "game_status", "metacritic_url")
    rows = []
    for pos, job in enumerate(found):
        job = job if isinstance(job, dict) else {}
        urls = job.get("review_urls")
        urls = [str(u).strip() for u in urls] if isinstance(urls, list) else []
        rows.append((pos, *(text_of(job, k) for k in names), urls, text_of(job, "refresh_evidence"), text_of(job, "refresh_incomplete_evidence")))
    return spark.createDataFrame(rows, QUEUE)


def queue_errors(jobs: DataFrame, least: int = 5) -> DataFrame:
    """Jobs with ``errors``, the reasons why they can't run."""
    empty = lambda c: F.trim(text.blank(F.col(c))) == ""
    page = F.trim(text.blank(F.col("metacritic_url")))
    found = F.array(F.when(empty("game"), "game"), F.when(empty("platform"), "platform"), F.when(page == "", "no url").when(~url.is_valid(page), "bad url"), F.when(F.size("review_urls") < least, "few reviews"))
    return jobs.withColumn("errors", F.array_compact(found))


MANUAL = "entry int, game string, platform string, source_url string, reviewed string, note_fa string, section string, pos int, point_fa string, evidence_en string"


def manual_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(points of the entries, status): a list of entries or a mapping that has one; what can't be read is ``invalid`` and empty."""
    try:
        content = _mapping(spark, path) or {}
    except Exception as e:  # noqa: BLE001 - a broken overlay must not stop a run; the reader of Spark and of YAML raise their own kinds
        return spark.createDataFrame([], MANUAL), "missing" if "PATH_NOT_FOUND" in str(e) else "invalid"
    entries = content if isinstance(content, list) else content.get("entries", []) if isinstance(content, dict) else []
    if not isinstance(entries, list):
        return spark.createDataFrame([], MANUAL), "invalid"
    rows = []
    for k, entry in enumerate(e for e in entries if isinstance(e, dict)):
        shown = lambda name, entry=entry: None if entry.get(name) is None else str(entry[name])
        head = (k, shown("game"), shown("platform"), shown("source_url") or shown("url"), shown("reviewed"), shown("note_fa"))
        for section in ("positives", "negatives", "technical_notes"):
            for pos, point in enumerate(p for p in entry.get(section) or [] if isinstance(p, dict)):
                rows.append((*head, section, pos + 1, str(point.get("point_fa") or ""), str(point.get("evidence_en") or "")))
    return spark.createDataFrame(rows, MANUAL), "loaded"


LOCALIZATION = "pos int, name string, label string, url string, anchor string"


def localizations(spark: SparkSession, path: str, base_url: str, prefix: str = "دانلود زیرنویس فارسی ") -> DataFrame:
    """(key, name, url, anchor) of the pages for names and aliases, the first of each key; anything that can't be read gives no rows.

    Pages must have an http(s) address on the site itself.
    """
    try:
        found = (_mapping(spark, path) or {}).get("localizations")
    except Exception:  # noqa: BLE001 - the feature is off without its file
        found = None
    rows = []
    for name, entry in (found if isinstance(found, dict) else {}).items():
        if isinstance(entry, dict):
            aliases = entry.get("aliases") or []
            for label in [name, *([aliases] if isinstance(aliases, str) else aliases)]:
                rows.append((len(rows), str(name or ""), str(label or ""), str(entry.get("url") or "").strip(), str(entry.get("anchor") or "")))
    pages = spark.createDataFrame(rows, LOCALIZATION).withColumns({c: text.clean_text(F.col(c)) for c in ("name", "anchor")})
    fit = pages.filter((F.col("name") != "") & F.lower("url").rlike("^https?://") & url.is_internal(F.col("url"), base_url))
    keyed = fit.withColumn("key", udfs.match_key(F.col("label"))).filter(F.col("key") != "")
    anchor = F.coalesce(text.or_null(F.col("anchor")), F.concat(F.lit(prefix), F.col("name")))
    return keyed.groupBy("key").agg(F.min_by(F.struct("name", "url", anchor.alias("anchor")), "pos").alias("p")).select("key", "p.*")


def localization_of(tags: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, name, url, anchor): of each item's tags (id, pos, tag) in order the first that has a page, by loose key."""
    keyed = tags.select("id", "pos", udfs.match_key(F.col("tag")).alias("key"))
    return keyed.join(pages, "key").groupBy("id").agg(F.min_by(F.struct("name", "url", "anchor"), "pos").alias("p")).select("id", "p.*")


EVIDENCE_POINT = "struct<point_fa:string,evidence_en:string,evidence_id:string>"
ANALYSIS = (
    "struct<site_name:string,title:string,url:string,original_score:string,review_score_10:double,score_method:string,score_confidence:int,score_evidence:string,"
    f"analysis_protocol:string,positives:array<{EVIDENCE_POINT}>,negatives:array<{EVIDENCE_POINT}>,technical_notes:array<{EVIDENCE_POINT}>,verdict:array<{EVIDENCE_POINT}>>"
)
CACHE = f"cache_version string, created_at_utc string, game string, platform string, requested_url string, final_url string, source_text_sha256 string, analysis {ANALYSIS}, refresh_meta struct<failed_selective_refreshes:int,manual_review:boolean>"


def evidence_cache(spark: SparkSession, path: str) -> DataFrame:
    """One row per cache file; unreadable files are rows of nulls with ``_corrupt``."""
    return spark.read.schema(CACHE + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def cached_analyses(cache: DataFrame, jobs: DataFrame, version: str) -> DataFrame:
    """Of each wanted (game, platform, url): the cache file that is its own, and ``cache_status`` hit, miss or invalid.

    A file counts if its version, game, platform and address are those asked for and its analysis has all fields.
    """
    key = lambda c: F.lower(text.clean_unescaped(c))
    own = cache.filter(F.col("requested_url").isNotNull()).withColumn("_u", url.cache_url(F.col("requested_url"))).withColumns({"_g": key(F.col("game")), "_p": key(F.col("platform"))}).drop("game", "platform")
    asked = jobs.withColumn("_u", url.cache_url(F.col("url"))).withColumns({"_g": key(F.col("game")), "_p": key(F.col("platform"))})
    a = F.col("analysis")
    whole = F.forall(F.array(*(a[c].isNotNull() for c in ("site_name", "title", "url", "positives", "negatives", "technical_notes"))), lambda x: x)
    valid = (F.col("cache_version") == version) & a.isNotNull() & F.coalesce(whole, F.lit(False))
    met = asked.join(own.withColumn("_valid", F.coalesce(valid, F.lit(False))), ["_u", "_g", "_p"], "left")
    one = met.groupBy("game", "platform", "url").agg(F.max(F.struct(F.coalesce("_valid", F.lit(False)).alias("valid"), F.col("_valid").isNotNull().alias("there"), "created_at_utc", "analysis", "refresh_meta")).alias("c"))
    status = F.when(F.col("c.valid"), "hit").when(F.col("c.there"), "invalid").otherwise("miss")
    return one.select("game", "platform", "url", status.alias("cache_status"), F.when(F.col("c.valid"), F.col("c.analysis")).alias("analysis"), F.when(F.col("c.valid"), F.col("c.refresh_meta")).alias("refresh_meta"))


def points_of(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, site_name, section, pos, point_fa, evidence_en): the points of analyses as rows, for audits that are computed anew."""
    sections = F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"analysis.{s}").alias("points")) for s in ("positives", "negatives", "technical_notes")))
    each = analyses.filter(F.col("analysis").isNotNull()).select(*keys, F.col("analysis.site_name").alias("site_name"), F.explode(sections).alias("s"))
    return each.select(*keys, "site_name", "s.section", F.posexplode("s.points").alias("pos", "p")).select(*keys, "site_name", "section", (F.col("pos") + 1).alias("pos"), "p.point_fa", "p.evidence_en")


IMAGE_TYPES = ["jpeg", "jpg", "png", "webp"]


def images(spark: SparkSession, path: str, min_width: int = 700, min_height: int = 350) -> DataFrame:
    """Image files with dimensions, the small ones rejected where the format tells."""
    return accepted_images(spark.read.format("binaryFile").load(path), min_width, min_height)


def accepted_images(files: DataFrame, min_width: int = 700, min_height: int = 350) -> DataFrame:
    """(path, length, content) files with dimensions and ``accepted``: the type that the name tells, if any, is one that can be
    shown, there is content, and the image is large enough where its header tells."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{2,5})(?:\?.*)?$", 1))
    rows = files.select("path", "length", ext.alias("ext"), udfs.image_dimensions(F.col("content")).alias("d"))
    large = (F.col("d.width") == 0) | ((F.col("d.width") >= min_width) & (F.col("d.height") >= min_height))
    return rows.withColumn("accepted", (F.col("length") > 0) & (F.col("ext").isin(IMAGE_TYPES) | (F.col("ext") == "")) & large)


def review_pages(pages: DataFrame, text_limit: int = 18_000) -> DataFrame:
    """Records of fetched (url, status, error, html) review pages: not ok with a reason, or ok with names, texts and all.

    The text is that of the main part, or of the whole page where that has fewer than 300 characters.
    """
    h, ok = F.col("html"), F.col("error").isNull() & (F.col("status") < 400)
    meta = html.page_meta(h)
    of = lambda *keys: F.coalesce(*(text.or_null(meta[k]) for k in keys), F.lit(""))
    main, whole = html.page_text(html.main_html(h)), html.page_text(h)
    body = F.when(F.length(main) < 300, whole).otherwise(main)
    site = text.clean_text(F.coalesce(url.reputable_name(F.col("url")), text.or_null(of("og:site_name", "application-name")), url.fallback_site_name(F.col("url"))))
    reason = F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    some = lambda c: F.when(ok, c)
    read = pages.withColumn("_body", some(body))
    return read.select(
        "url", "status", ok.alias("ok"), F.when(~ok, reason).alias("error"), some(site).alias("site_name"), some(text.clean_text(F.coalesce(text.or_null(of("og:title", "twitter:title")), html.page_title(h)))).alias("title"),
        some(text.clean_text(of("description", "twitter:description", "og:description"))).alias("description"), F.substring("_body", 1, text_limit).alias("text"), F.col("_body").alias("score_text"), F.length("_body").alias("text_chars"), some(h).alias("html"),
    )
