"""Published posts: similar ones, tags by key, related ones, existing drafts. Posts are a table, so each lookup is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import html, text, url

from . import similarity


def _words_key(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def _newest(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("published_ts"), "post_id"))).filter(F.col("place") <= n)


def found_by_words(items: DataFrame, posts: DataFrame, words: int, per_item: int = 10) -> DataFrame:
    """(id, post_id, place): the newest posts that hold all search words of an item's title, ``per_item`` at most.

    ``items``: (id, title); ``posts``: (post_id, title, published_ts). Items of the same words are one search, posts of the same
    words one candidate, of which no more than the newest ``per_item`` can be found. A search meets the posts of its rarest
    word, which are then asked for the others.
    """
    asked = items.select("id", F.array_distinct(F.split(text.search_keywords(F.col("title"), words), " ")).alias("w")).filter(F.col("w")[0] != "").withColumn("key", _words_key(F.col("w")))
    searches = asked.groupBy("key").agg(F.first("w").alias("w"))
    held = posts.select("post_id", "published_ts", F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text.blank(F.col("title"))), r"[^a-z0-9]+", " ")), " ")).alias("t")).withColumn("post_key", _words_key(F.col("t")))
    kinds = held.groupBy("post_key").agg(F.first("t").alias("t")).select("post_key", "t", F.explode("t").alias("word"))
    counts = kinds.groupBy("word").agg(F.count("*").alias("n"))
    # a word that no post holds leaves the search without an answer
    rarest = searches.select("key", "w", F.explode("w").alias("word")).join(counts, "word", "left").groupBy("key").agg(F.first("w").alias("w"), F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    met = rarest.join(kinds, "word").filter(F.size(F.array_except("w", "t")) == 0).select("key", "post_key")
    newest = _newest(held.select("post_key", "post_id", "published_ts"), "post_key", per_item).drop("place")
    answers = _newest(met.join(newest, "post_key"), "key", per_item).groupBy("key").agg(F.collect_list(F.struct("post_id", "place")).alias("found"))
    return asked.select("id", "key").join(answers, "key").select("id", F.inline("found"))


def similar_posts(items: DataFrame, posts: DataFrame, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """(id, post_id, score): the most similar post of each item among those a search finds, where it reaches the threshold.

    Titles of fewer than five tokens are like none; each pair of different titles is scored once.
    """
    titled = lambda df, key, name: df.select(key, text.normalize_title(F.col("title")).alias(name)).filter(F.size(text.tokens(F.col(name))) >= similarity.MIN_TOKENS)
    a, b = titled(items, "id", "a"), titled(posts, "post_id", "b")
    found = found_by_words(items.join(a.select("id"), "id", "left_semi"), posts, 6).join(a, "id").join(b, "post_id")
    scored = found.select("a", "b").distinct().withColumn("score", similarity.similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    best = found.join(scored, ["a", "b"]).groupBy("id").agg(F.max_by(F.struct("post_id", "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select("id", F.col("b.post_id").alias("post_id"), F.col("b.score").alias("score"))


def resolved_tags(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, pos, name, key, term_id, created): the term of each tag by its key, of several the smallest; missing ones get an id of their key.

    ``tags``: (id, pos, name); ``terms``: (term_id, name). An id made from a key is the same whenever it is made, so
    two runs that race create one term.
    """
    named = tags.withColumns({"name": text.clean_text(F.col("name"))}).withColumn("key", text.tag_key(F.col("name"))).filter((F.col("name") != "") & (F.col("key") != ""))
    known = terms.select("term_id", text.tag_key(F.col("name")).alias("key")).groupBy("key").agg(F.min("term_id").alias("term_id"))
    made = F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return named.join(known, "key", "left").select("id", "pos", "name", "key", F.coalesce("term_id", made).alias("term_id"), F.col("term_id").isNull().alias("created"))


def tag_ids(resolved: DataFrame) -> DataFrame:
    """(id, term_ids): distinct term ids of each item, in the order of its tags."""
    first = resolved.groupBy("id", "term_id").agg(F.min("pos").alias("pos"))
    return first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term_id"))), lambda x: x["term_id"]).alias("term_ids"))


def new_terms(resolved: DataFrame) -> DataFrame:
    """(term_id, name) to be added to the terms: the first spelling of each missing key."""
    return resolved.filter("created").groupBy("term_id").agg(F.min_by("name", F.struct("id", "pos")).alias("name"))


def related_posts(candidates: DataFrame, excluded: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Candidates (keys, post_id, link, title, prio) without excluded addresses: each post once, by priority, then place, the first ``limit``.

    ``excluded``: (link) of pages that are not to be linked. An address is compared by its host and path.
    """
    out = excluded.select(url.identity(F.col("link")).alias("identity")).distinct()
    left = candidates.withColumn("identity", url.identity(F.col("link"))).join(out, "identity", "left_anti")
    one = left.groupBy(*keys, "post_id").agg(F.min_by(F.struct("link", "title", "prio"), "prio").alias("p")).select(*keys, "post_id", "p.*")
    if not keys:
        return one.orderBy("prio", "post_id").limit(limit)
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("prio", "post_id"))).filter(F.col("place") <= limit)


def related_html(found: Column, heading: str = "مطالب مرتبط", limit: int = 4) -> Column:
    """The older markup of related posts: a heading and a list of (title, link); empty without any."""
    fit = F.slice(F.filter(found, lambda x: (text.blank(x["title"]) != "") & (text.blank(x["link"]) != "")), 1, limit)
    each = F.transform(fit, lambda x: F.concat(F.lit('<li><a href="'), html.escape(x["link"]), F.lit('">'), html.escape(x["title"]), F.lit("</a></li>")))
    return F.when(F.size(each) > 0, F.concat(F.lit(f"<h2>{heading}</h2>\n<ul>\n"), F.array_join(each, "\n"), F.lit("\n</ul>"))).otherwise("")


def existing_drafts(drafts: DataFrame, posts: DataFrame) -> DataFrame:
    """(draft_key, post_id): the post of a draft, by its slug or by the key that its text carries; the smallest of several."""
    by_slug = drafts.join(posts.select("post_id", "slug"), "slug").select("draft_key", "post_id")
    marker = F.regexp_extract(text.blank(F.col("content")), r'data-draft-key="([^"]+)"', 1)
    by_key = drafts.select("draft_key").join(posts.select("post_id", marker.alias("draft_key")), "draft_key").select("draft_key", "post_id")
    return by_slug.union(by_key).groupBy("draft_key").agg(F.min("post_id").alias("post_id"))
