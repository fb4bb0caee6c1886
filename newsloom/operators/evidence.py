"""Evidence of reviews: points, catalogs, audits, merges, refresh decisions, facts.

A table of points has one row per point: game, platform, source_no, site_name, section, pos,
point_fa, evidence_en. Sections come in a fixed order; ``pos`` is the place within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import scores, text
from newsloom.functions import vocabulary as V

SECTIONS = ["positives", "negatives", "technical_notes"]
MIN_POINTS = 2
MAX_MERGED = 6
MAX_FAILED_REFRESHES = 2


def section_rank(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), c)


def classified(points: DataFrame) -> DataFrame:
    """Points with category and sentiment."""
    return points.withColumn("_c", text.classify_evidence(F.col("evidence_en"), F.col("section"))).select(*points.columns, F.col("_c.category").alias("category"), F.col("_c.sentiment").alias("sentiment"))


def audit(points: DataFrame, keys: list[str], min_points: int = MIN_POINTS) -> DataFrame:
    """Counts, categories, status and rank of each source; one aggregation."""
    c = classified(points)
    found = c.groupBy(*keys).agg(
        *(F.count_if(F.col("section") == s).alias(f"n_{s}") for s in SECTIONS),
        F.count("section").alias("verified_points"),
        F.count("category").alias("categorised_points"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    )
    n, k, size = F.col("verified_points"), F.col("categorised_points"), F.size("categories")
    labels = F.array(*(F.lit(x) for x in V.COVERAGE_LABELS))
    return found.select(
        "*",
        size.alias("n_categories"),
        F.when((n < min_points) | (n.isNotNull() & (k == 0)), "needs_review").otherwise("acceptable").alias("status"),
        F.element_at(labels, F.least(size, F.lit(3)) + 1).alias("coverage"),
        scores.quality_rank(n, k, size.cast("bigint")).alias("quality_rank"),
    )


def catalog(pages: DataFrame, key: str, max_items: int = 150) -> DataFrame:
    """(key, evidence_id, sentence): quotable sentences of title, description and text, numbered.

    Sentences are found and made distinct within the row, so nothing is shuffled.
    """
    every = F.concat(*(text.evidence_sentences(F.col(c), limit=max_items) for c in ("title", "description", "text")))
    kept = text.ordered_distinct(every, F.lower, max_items)
    return pages.select(key, F.posexplode(kept).alias("_at", "sentence")).select(key, F.format_string("E%03d", F.col("_at") + 1).alias("evidence_id"), "sentence")


def point_key(evidence: Column, claim: Column) -> Column:
    quote = F.lower(text.clean_unescaped(evidence))
    return F.coalesce(text.or_null(quote), F.lower(text.clean_unescaped(claim)))


def merged(cached: DataFrame, candidate: DataFrame, keys: list[str], limit: int = MAX_MERGED) -> DataFrame:
    """Points of both analyses: cached ones first, each quote once in a section, at most ``limit``."""
    both = cached.withColumn("_from", F.lit(0)).unionByName(candidate.withColumn("_from", F.lit(1)))
    both = both.withColumns({c: text.clean_unescaped(F.col(c)) for c in ("point_fa", "evidence_en")}).filter((F.col("point_fa") != "") & (F.col("evidence_en") != ""))
    both = both.withColumn("_key", point_key(F.col("evidence_en"), F.col("point_fa")))
    first = Window.partitionBy(*keys, "section", "_key").orderBy("_from", "pos")
    placed = Window.partitionBy(*keys, "section").orderBy("_from", "pos")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("place", F.row_number().over(placed)).filter(F.col("place") <= limit).drop("_n", "_key", "_from")


def clean_point(claim: Column, quote: Column, low: int = 8, high: int = 26) -> Column:
    """Whether a clean claim and its quote are complete, readable, of a quotable length, and agree."""
    return (quote != "") & (claim != "") & ~text.broken(quote) & ~text.broken(claim) & text.evidence_word_count(quote).between(low, high) & text.claim_compatible(claim, quote)


def manual_point_valid(claim: Column, quote: Column) -> Column:
    """Whether a point entered by hand has a claim of three characters and a quote of 8 to 22 words."""
    fa, en = text.clean_unescaped(claim), text.clean_unescaped(quote)
    return (F.length(fa) >= 3) & (F.length(en) >= 8) & text.evidence_word_count(quote).between(8, 22)


def needs_upgrade(points: DataFrame, keys: list[str], low: int = 8, high: int = 26) -> DataFrame:
    """Whether an analysis has an unclean point, or one quote in two sections."""
    quote, claim = text.clean_unescaped(F.col("evidence_en")), text.clean_unescaped(F.col("point_fa"))
    clean = clean_point(claim, quote, low, high)
    by_quote = points.select(*keys, "section", clean.alias("clean"), F.lower(quote).alias("quote")).groupBy(*keys, "quote").agg(F.bool_and("clean").alias("clean"), F.min("section").alias("a"), F.max("section").alias("b"))
    return by_quote.groupBy(*keys).agg(F.bool_or(~F.col("clean") | (F.col("a") != F.col("b"))).alias("needs_upgrade"))


def overlay(points: DataFrame, manual: DataFrame) -> DataFrame:
    """Points with those of reviewed manual entries whose game, url and platform (blank: any) match.

    ``points`` sources: (game, platform, cache_url, ...); ``manual``: (game, platform, cache_url, reviewed,
    section, pos, point_fa, evidence_en). The equi-join is on game and url; the platform is a filter.
    """
    sources = points.select("game", "platform", "cache_url", "source_no", "site_name").distinct()
    key = lambda c: F.lower(text.clean_unescaped(c))
    m = manual.filter(text.is_true(F.col("reviewed"))).select(key(F.col("game")).alias("_g"), key(F.col("platform")).alias("_p"), F.col("cache_url").alias("_u"), "section", "pos", "point_fa", "evidence_en")
    matched = sources.join(m, (key(sources["game"]) == m["_g"]) & (sources["cache_url"] == m["_u"])).filter((F.col("_p") == "") | (F.col("_p") == key(F.col("platform"))))
    return matched.select("game", "platform", "cache_url", "source_no", "site_name", "section", "pos", "point_fa", "evidence_en")


def after_refresh(rows: DataFrame, max_failed: int = MAX_FAILED_REFRESHES) -> DataFrame:
    """Refresh state of each source after an attempt: (old_rank, new_rank, new_status, failed) -> accepted, failed, manual_review."""
    accepted = F.col("new_rank") > F.col("old_rank")
    failed = F.when(accepted | (F.col("new_status") != "needs_review"), F.when(accepted, 0).otherwise(1)).otherwise(F.least(F.col("failed"), F.lit(99)) + 1)
    return rows.withColumn("accepted", accepted).withColumn("failed_after", failed.cast("int")).withColumn("manual_review", (F.col("new_status") == "needs_review") & ~accepted & (F.col("failed_after") >= max_failed))


def select_catalog_points(chosen: DataFrame, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """Chosen (section, pos, evidence_id, point_fa, evidence_en) rows, sections in order: an id and a
    quote are used once in all, each section takes its cap, and rejected rows use up nothing."""
    order = list(caps)

    def fold(rows):
        ids, quotes, taken, kept = set(), set(), {}, []
        ranked = rows.assign(_s=rows["section"].map(order.index)).sort_values(["_s", "pos"], kind="stable")
        for at, r in ranked.iterrows():
            quote = r["evidence_en"].casefold()
            if taken.get(r["section"], 0) < caps[r["section"]] and r["evidence_id"] not in ids and quote not in quotes:
                ids.add(r["evidence_id"])
                quotes.add(quote)
                taken[r["section"]] = taken.get(r["section"], 0) + 1
                kept.append(at)
        return rows.loc[kept]

    clean = chosen.filter(F.col("section").isin(order) & text.claim_compatible(F.col("point_fa"), F.col("evidence_en")))
    return clean.groupBy(*keys).applyInPandas(fold, chosen.schema)


# --- facts --------------------------------------------------------------------------------------


def specificity(claim: Column) -> Column:
    return F.size(F.filter(F.array(*(F.lit(m) for m in V.SPECIFIC_MARKERS)), lambda m: F.contains(claim, m)))


def is_specific(claim: Column, quote: Column) -> Column:
    c = F.lower(text.clean_unescaped(claim))
    generic = F.exists(F.array(*(F.lit(m) for m in V.GENERIC_MARKERS)), lambda m: F.contains(c, m))
    words = F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    return (words >= 4) & ~text.broken(c) & (text.evidence_word_count(quote) <= 42) & (~generic | (specificity(c) > 0))


def topic(claim: Column, quote: Column, section: Column) -> Column:
    c = F.lower(text.clean_unescaped(claim))
    out = F.when(F.lit(False), F.lit(""))
    for name, terms in V.TOPIC_TERMS.items():
        out = out.when(F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(c, t)), F.lit(name))
    return F.coalesce(text.classify_evidence(quote, section)["category"], out.otherwise("general"))


def facts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Specific points as facts, without quotes that are praise and blame at once, ranked."""
    claim, quote = text.clean_unescaped(F.col("point_fa")), text.clean_unescaped(F.col("evidence_en"))
    sentiment = F.when(F.col("section") == "positives", "positive").when(F.col("section") == "negatives", "negative").otherwise("caution")
    found = points.filter(is_specific(F.col("point_fa"), F.col("evidence_en"))).select(
        *keys, F.format_string("F%02d%s%d", F.col("source_no"), F.upper(F.substring("section", 1, 1)), F.col("pos")).alias("fact_id"), "site_name", topic(F.col("point_fa"), F.col("evidence_en"), F.col("section")).alias("topic"),
        sentiment.alias("sentiment"), claim.alias("text_fa"), F.coalesce(text.or_null(F.lower(quote)), F.lower(claim)).alias("evidence_key"),
        specificity(F.lower(claim)).alias("specificity"), F.col("source_no").alias("_no"), section_rank(F.col("section")).alias("_s"), F.col("pos").alias("_p"),
    )
    conflicts = found.groupBy(*keys, "evidence_key").agg(F.bool_or(F.col("sentiment") == "positive").alias("p"), F.bool_or(F.col("sentiment") == "negative").alias("n")).filter("p and n")
    left = found.join(conflicts.select(*keys, "evidence_key"), [*keys, "evidence_key"], "left_anti")
    order = F.array(*(F.lit(t) for t in V.TOPIC_ORDER))
    w = Window.partitionBy(*keys).orderBy(F.array_position(order, F.col("topic")), F.when(F.col("sentiment").isin("positive", "negative"), 0).otherwise(1), F.desc("specificity"), F.length("text_fa"), "_no", "_s", "_p")
    return left.withColumn("rank", F.row_number().over(w)).drop("_no", "_s", "_p")


def capped_facts(ranked: DataFrame, keys: list[str], per_site: int = 5, limit: int = 24) -> DataFrame:
    """The facts of each article: at most five of a site, of a topic its limit, each text once."""
    from .ordered import greedy_capped

    key = F.trim(F.regexp_replace(F.lower("text_fa"), r"(?U)[\W_]+", " "))
    rows = ranked.withColumn("text_key", key).filter(F.col("text_key") != "")
    return greedy_capped(rows, keys, ["rank"], {"text_key": 1, "site_name": per_site, "topic": V.TOPIC_LIMITS}, limit).drop("text_key")


PLAN = [
    # part, topics, sentiments, how many
    ("opening_positive", ["world_design"], ["positive"], 1),
    ("opening_negative", ["gameplay", "story", "technical"], ["negative", "caution"], 1),
    ("world_gameplay", ["world_design", "gameplay"], ["positive"], 3),
    ("friction", ["gameplay", "story", "technical"], ["negative", "caution"], 3),
]


LEAST = {"opening_positive": 1, "opening_negative": 1, "world_gameplay": 2, "friction": 2}
"""What each part needs, or there is no plan."""

_PRAISED = ["gameplay", "world_design", "visuals", "audio", "story", "value", "general"]
_BLAMED = [*_PRAISED, "technical"]
LONG_PLAN = [
    ("opening_positive", _PRAISED, ["positive"], 1),
    ("opening_negative", _BLAMED, ["negative", "caution"], 1),
    ("world_gameplay", _PRAISED, ["positive"], 5),
    ("friction", _BLAMED, ["negative", "caution"], 5),
]
LONG_LEAST = {"opening_positive": 1, "opening_negative": 1, "world_gameplay": 4, "friction": 4}

SYNTHESIS = {"audience": ["world_gameplay", "friction"], "conclusion": ["opening_positive", "opening_negative"]}
"""Parts that take no facts of their own: the first of each of these."""


def editorial_plan(found: DataFrame, keys: list[str], plan=None, least: dict[str, int] | None = None) -> DataFrame:
    """(part, fact_id, place): each part takes facts no part before it took, one of a site before any second.

    Articles with fewer facts than a part needs have no plan, hence no rows. Audience and conclusion take
    the first facts of other parts again. The long-form plan: ``plan=LONG_PLAN, least=LONG_LEAST``.
    """
    plan, least = plan or PLAN, LEAST if least is None else least
    taken, out = None, None
    for part, topics, sentiments, n in plan:
        rows = found.filter(F.col("topic").isin(topics) & F.col("sentiment").isin(sentiments))
        if taken is not None:
            rows = rows.join(taken, [*keys, "fact_id"], "left_anti")
        by = (F.when(F.col("site_name") == "", 1).otherwise(0), F.desc("specificity"), F.length("text_fa"), F.col("fact_id"))
        again = rows.withColumn("_again", (F.row_number().over(Window.partitionBy(*keys, "site_name").orderBy(*by)) > 1).cast("int"))
        placed = again.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_again", *by))).filter(F.col("place") <= n)
        picked = placed.select(*keys, F.lit(part).alias("part"), "fact_id", "place")
        taken = picked.select(*keys, "fact_id") if taken is None else taken.union(picked.select(*keys, "fact_id"))
        out = picked if out is None else out.union(picked)
    enough = out.groupBy(*keys).agg(*(F.count_if(F.col("part") == part).alias(part) for part in least))
    for part, n in least.items():
        enough = enough.filter(F.col(part) >= n)
    out = out.join(enough.select(*keys), keys, "left_semi")
    for part, of in SYNTHESIS.items():
        place = F.array_position(F.array(*(F.lit(x) for x in of)), F.col("part")).cast("int")
        firsts = out.filter(F.col("part").isin(of) & (F.col("place") == 1))
        out = out.union(firsts.select(*keys, F.lit(part).alias("part"), "fact_id", place.alias("place")))
    return out


def section_problem(value: Column, site_names: list[str], low: int | Column, high: int | Column, own_name: str = "") -> Column:
    """The first reason why a section can't be published; null if there is none. ``own_name``: what the publishing site is called, a forbidden word."""
    v = text.clean_unescaped(value)
    folded, words = F.lower(v), F.size(F.filter(F.split(text.clean_unescaped(value), " "), lambda w: w != ""))
    holds = lambda terms: F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(folded, t)) if terms else F.lit(False)
    return (
        F.when(v == "", "empty").when(text.broken(v), "broken").when(words < low, "short").when(words > high, "long")
        .when(v.rlike(r"https?://|[#*`]|(?:^|\s)-\s"), "markup").when(holds([*V.FORBIDDEN_WORDS, *([own_name] if own_name else [])]), "forbidden").when(holds(site_names), "site").when(holds(V.TRAILER_WORDS), "trailer")
    )


def drift_problem(old: Column, new: Column, low: float = 0.5, factor: float = 1.35, extra: int = 8, site_names: list[str] | None = None, article: Column | None = None, details: bool = True) -> Column:
    """Why a rewrite strays from its text: a new number, too few or many words, the name of a site, or a concrete
    detail that neither the text nor the whole ``article`` has; null if it does not. The narrative rewrite's
    settings: ``low=0.45, factor=2.5, extra=15, details=False`` and only the sites that are not allowed."""
    n, m = (F.size(F.filter(F.split(text.clean_unescaped(c), " "), lambda w: w != "")) for c in (old, new))
    was, now = F.lower(text.clean_unescaped(old)), F.lower(text.clean_unescaped(new))
    known = was if article is None else F.concat_ws(" ", was, F.lower(text.clean_unescaped(article)))
    site = F.exists(F.array(*(F.lit(x.lower()) for x in site_names)), lambda x: F.contains(now, x)) if site_names else F.lit(False)
    marked = F.exists(F.array(*(F.lit(x) for x in V.SPECIFIC_MARKERS)), lambda x: F.contains(now, x) & ~F.contains(known, x))
    return F.when(F.size(F.array_except(text.numbers(new), text.numbers(old))) > 0, "number").when(m < n * low, "short").when(m > n * factor + extra, "long").when(site, "site").when(F.lit(details) & marked, "detail")
