"""Articles: backing of sentences, checks of sections, citations, points, reports, and the choice among candidates.

Tables are keyed by the columns in ``keys`` (an article). Sections are rows (keys, part, text_fa), supports are rows
(keys, part, fact_id), and facts are those of ``evidence.facts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import scores, text
from newsloom.functions import vocabulary as V

from . import evidence


def _holds(value: Column, words: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(value, w))


def _first(value: Column, words: list[str]) -> Column:
    """The first of the words that a text contains; null if none."""
    return F.try_element_at(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(value, w)), F.lit(1))


# --- sentences and sections -----------------------------------------------------------------------


def unbacked(sentence: Column) -> Column:
    """Whether a sentence only praises: a general adjective, no concrete detail, and no negation of it."""
    s = F.lower(text.clean_unescaped(sentence))
    return _holds(s, V.PROSE_ADJECTIVES) & ~_holds(s, V.PROSE_DETAILS) & ~_holds(s, V.PROSE_NEGATIONS)


def claim_problem(part: Column, value: Column) -> Column:
    """What is wrong with a section's claims: a phrase its part must not have, an empty phrase, or an unbacked sentence."""
    v = text.clean_unescaped(value)
    folded = F.lower(v)
    out = F.lit(None).cast("string")
    for name, phrases in V.PART_PHRASES.items():
        out = F.coalesce(out, F.when(part == name, F.concat(F.lit("phrase: "), _first(folded, phrases))))
    sentences = F.filter(F.split(v, rf"(?<=[.!؟?]){text.SPACE}+"), lambda s: (s != "") & unbacked(s))
    told = F.when(part.isin(V.FACTUAL_PARTS) & (F.size(sentences) > 0), F.concat(F.lit("sentence: "), sentences[0]))
    return F.coalesce(out, F.concat(F.lit("general: "), _first(folded, V.EMPTY_PHRASES)), told)


def checked_sections(sections: DataFrame, bounds: dict[str, tuple[int, int]], site_names: list[str], own_name: str = "") -> DataFrame:
    """Sections with ``words`` and ``problem``: the first reason against each, by the bounds of its part; null if there is none."""
    low, high = (text.lookup(F.col("part"), {k: str(b[at]) for k, b in bounds.items()}).cast("int") for at in (0, 1))
    v = text.clean_unescaped(F.col("text_fa"))
    words = F.size(F.filter(F.split(v, " "), lambda w: w != ""))
    problem = F.coalesce(evidence.section_problem(F.col("text_fa"), site_names, low, high, own_name), claim_problem(F.col("part"), F.col("text_fa")))
    return sections.filter(F.col("part").isin(list(bounds))).withColumns({"words": words, "problem": problem})


def article_verdicts(checked: DataFrame, keys: list[str], bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Of each article: all its words, and the first problem in the order of the parts; a missing part is one."""
    order = F.array(*(F.lit(p) for p in bounds))
    of = checked.groupBy(*keys).agg(
        F.sum("words").cast("int").alias("words"), F.collect_set("part").alias("_parts"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct(F.array_position(order, F.col("part")).alias("at"), "part", "problem"))).alias("_first"),
    )
    missing = F.try_element_at(F.array_except(order, "_parts"), F.lit(1))
    found = F.when(F.col("_first").isNotNull(), F.concat(F.col("_first.part"), F.lit(": "), F.col("_first.problem")))
    return of.select(*keys, "words", F.when(missing.isNotNull(), F.concat(missing, F.lit(": missing"))).otherwise(found).alias("problem"))


def balanced_supports(supports: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, balanced): whether a section rests on something positive and on something negative or cautious."""
    met = supports.join(facts.select(*keys, "fact_id", "sentiment"), [*keys, "fact_id"], "left")
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("sentiment").isin(*kinds)), F.lit(False))
    return met.groupBy(*keys, "part").agg((has("positive") & has("negative", "caution")).alias("balanced"))


def supports_problem(supports: DataFrame, facts: DataFrame, keys: list[str], least: int, topics: list[str] | None = None, sentiments: list[str] | None = None) -> DataFrame:
    """(keys, part, problem): too few known supports, or none with a topic or a sentiment that the section needs."""
    met = supports.dropDuplicates([*keys, "part", "fact_id"]).join(facts.select(*keys, "fact_id", "topic", "sentiment"), [*keys, "fact_id"], "left")
    fits = lambda c, wanted: F.coalesce(F.bool_or(F.col(c).isin(wanted)), F.lit(False)) if wanted else F.lit(True)
    found = met.groupBy(*keys, "part").agg(F.count("sentiment").alias("n"), fits("topic", topics).alias("t"), fits("sentiment", sentiments).alias("s"))
    return found.select(*keys, "part", F.when(F.col("n") < least, "supports").when(~F.col("t"), "topic").when(~F.col("s"), "sentiment").alias("problem"))


LENGTH_TARGET, LENGTH_GOAL = (800, 1000), 900


def chosen_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate (attempt, words) of each article within the target length, or nearest to the goal, or first."""
    outside = ~F.col("words").between(*LENGTH_TARGET)
    best = candidates.groupBy(*keys).agg(F.min(F.struct(outside.alias("outside"), F.abs(F.col("words") - LENGTH_GOAL).alias("off"), "attempt", "words")).alias("b"))
    return best.select(*keys, F.col("b.attempt").alias("attempt"), F.col("b.words").alias("words"), (~F.col("b.outside")).alias("target_met"))


# --- citations and points -------------------------------------------------------------------------


def citations(supports: DataFrame, quotes: DataFrame, cards: DataFrame, meta: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """(keys, block, place, site_name, url): the sources that a block's supports lead to, in order, each once.

    ``supports``: (keys, block, pos, ref), where a ref is a quote, a card, or META; ``quotes``: (keys, ref, site_name, url);
    ``cards``: (keys, card, at, ref), the quotes of a card in order; ``meta``: (keys, url) of the game's page of all scores.
    """
    direct = supports.join(quotes, [*keys, "ref"]).select(*keys, "block", "pos", F.lit(0).alias("at"), "site_name", "url")
    through = supports.withColumnRenamed("ref", "card").join(cards, [*keys, "card"]).join(quotes, [*keys, "ref"]).select(*keys, "block", "pos", "at", "site_name", "url")
    whole = supports.filter(F.col("ref") == "META").join(meta, keys).select(*keys, "block", "pos", F.lit(0).alias("at"), F.lit("Metacritic").alias("site_name"), "url")
    every = direct.union(through).union(whole).withColumns({"site_name": text.clean_unescaped(F.col("site_name")), "url": F.trim(text.blank(F.col("url")))})
    first = every.filter((F.col("site_name") != "") & (F.col("url") != "")).groupBy(*keys, "block", "site_name", "url").agg(F.min(F.struct("pos", "at")).alias("first"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "block").orderBy("first", "site_name", "url")))
    return placed.filter(F.col("place") <= limit).select(*keys, "block", "place", "site_name", "url")


def rendered_citations(cited: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, links): Markdown links in order, after a space."""
    link = F.concat(F.lit("["), F.col("site_name"), F.lit("]("), F.col("url"), F.lit(")"))
    lists = cited.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("place", link.alias("link")))).alias("l"))
    return lists.select(*keys, "block", F.concat(F.lit(" "), F.array_join(F.col("l.link"), " ")).alias("links"))


UNKNOWN_SITE = "منبع نامشخص"


def article_points(points: DataFrame, keys: list[str], limit: int = 6) -> DataFrame:
    """(keys, section, place, point_fa, site_name, url): each claim of a section once, in the order of the sources."""
    claim = points.withColumn("point_fa", text.clean_unescaped(F.col("point_fa"))).filter(F.col("point_fa") != "")
    order = F.struct("source_no", "pos")
    rows = claim.groupBy(*keys, "section", F.lower("point_fa").alias("_key")).agg(F.min(order).alias("_at"), F.min_by(F.struct("point_fa", "site_name", "url"), order).alias("p"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "section").orderBy("_at"))).filter(F.col("place") <= limit)
    site = F.coalesce(text.or_null(text.clean_unescaped(F.col("p.site_name"))), F.lit(UNKNOWN_SITE))
    return placed.select(*keys, "section", "place", F.col("p.point_fa").alias("point_fa"), site.alias("site_name"), F.trim(text.blank(F.col("p.url"))).alias("url"))


def point_line(claim: Column, site: Column, url: Column) -> Column:
    """A claim as a Markdown bullet with its source."""
    return F.concat(F.lit("- "), claim, F.when(url != "", F.concat(F.lit(" ["), site, F.lit("]("), url, F.lit(")"))).otherwise(F.concat(F.lit(" ("), site, F.lit(")"))))


def card_points(points: DataFrame, keys: list[str], each: int = 2) -> DataFrame:
    """The first claims of each category and polarity, for the text of its card; neutral ones belong to none."""
    c = evidence.classified(points).filter(F.col("sentiment").isin("positive", "negative"))
    c = c.withColumn("category", F.when(F.col("category") == "audio", "visuals").otherwise(F.col("category")))
    w = Window.partitionBy(*keys, "category", "sentiment").orderBy("source_no", evidence.section_rank(F.col("section")), "pos")
    return c.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each).select(*keys, "category", "sentiment", "place", "point_fa", "site_name")


# --- evidence of a dossier --------------------------------------------------------------------------


def evidence_index(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, site_name, section, point_fa, evidence_en): every complete point under an id of its own."""
    fa, en = text.clean_unescaped(F.col("point_fa")), text.clean_unescaped(F.col("evidence_en"))
    ref = F.format_string("S%d:%s:%d", F.col("source_no"), F.col("section"), F.col("pos"))
    site = F.coalesce(F.col("site_name"), F.lit("Unknown Source"))
    return points.filter((fa != "") & (en != "")).select(*keys, ref.alias("ref"), site.alias("site_name"), "section", fa.alias("point_fa"), en.alias("evidence_en"))


def uncategorised(index: DataFrame, keys: list[str]) -> DataFrame:
    """References whose quote belongs to no category of the scorecard."""
    return evidence.classified(index).filter(F.col("category").isNull()).select(*keys, "ref")


def verified_points(points: DataFrame, keys: list[str], limit: int = 4, low: int = 8, high: int = 26) -> DataFrame:
    """Clean points of each section, one for each quote, the first ``limit``; places are new."""
    clean = points.withColumns({c: text.clean_unescaped(F.col(c)) for c in ("point_fa", "evidence_en")}).filter(evidence.clean_point(F.col("point_fa"), F.col("evidence_en"), low, high))
    first = Window.partitionBy(*keys, "section", F.lower("evidence_en")).orderBy("pos")
    one = clean.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "section").orderBy("pos"))).filter(F.col("place") <= limit).drop("_n")


def upgraded(cached: DataFrame, fresh: DataFrame, keys: list[str], limit: int = evidence.MAX_MERGED) -> DataFrame:
    """Points after a protocol upgrade: fresh ones, then what is clean of the cached; a quote is used in one section only."""
    both = fresh.withColumn("_from", F.lit(0)).unionByName(cached.withColumn("_from", F.lit(1)))
    both = both.withColumns({c: text.clean_unescaped(F.col(c)) for c in ("point_fa", "evidence_en")}).filter(evidence.clean_point(F.col("point_fa"), F.col("evidence_en")))
    both, out = both.withColumn("_quote", F.lower("evidence_en")), None
    for section in evidence.SECTIONS:
        rows = both.filter(F.col("section") == section)
        if out is not None:
            rows = rows.join(out.select(*keys, "_quote"), [*keys, "_quote"], "left_anti")
        one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_quote").orderBy("_from", "pos"))).filter("_n = 1")
        kept = one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_from", "pos"))).filter(F.col("place") <= limit).select(*keys, "section", "place", "point_fa", "evidence_en", "_quote")
        out = kept if out is None else out.unionByName(kept)
    return out.drop("_quote")


def quality_rows(audits: DataFrame, keys: list[str], max_failed: int = evidence.MAX_FAILED_REFRESHES) -> DataFrame:
    """Audits with what was done about them: status, action, and whether the source counts.

    ``audits``: those of ``evidence.audit`` with manual_points (null: no manual entry was applied), failed (refreshes) and manual_review.
    """
    applied = F.coalesce("manual_points", F.lit(0)) > 0
    review = F.coalesce("manual_review", F.lit(False)) & (F.col("status") == "needs_review")
    status = F.when(applied & (F.col("status") == "acceptable"), "manual_supported").when(review, "manual_review").otherwise(F.col("status"))
    action = text.lookup(status, V.QUALITY_ACTIONS)
    return audits.withColumns({"failed": F.coalesce("failed", F.lit(0)), "manual_points": F.coalesce("manual_points", F.lit(0)), "max_failed": F.lit(max_failed), "action_fa": action, "usable": status.isin("acceptable", "manual_supported"), "status": status})


def incomplete_report(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """One row for each dossier with too few usable sources: how many there are, and the sources on both sides."""
    source = F.struct("site_name", "status", "verified_points", "categorised_points", "action_fa")
    lists = [F.sort_array(F.collect_list(F.when(F.col("usable") == kind, source))).alias(name) for name, kind in (("usable_sources", True), ("thin_sources", False))]
    found = rows.groupBy(*keys).agg(F.count_if("usable").alias("n_usable"), F.count("*").alias("n_sources"), *lists)
    return found.filter(F.col("n_usable") < least).withColumn("needed", F.lit(least) - F.col("n_usable"))


def counters(items: DataFrame, posted: Column, words: Column) -> DataFrame:
    """One row: added and posted items, and words in all."""
    return items.agg(F.count("*").alias("added"), F.count_if(posted).alias("posted"), F.coalesce(F.sum(words), F.lit(0)).cast("bigint").alias("words"))


# --- the article that rules write -----------------------------------------------------------------


def _labels(kind: Column) -> Column:
    """Labels of the categories for which ``kind`` holds, in the order of the scorecard, joined; empty without any."""
    found = F.sort_array(F.collect_list(F.when(kind, F.struct("place", text.lookup(F.col("category"), V.SCORECARD_LABELS).alias("label")))))
    return F.array_join(F.transform(found, lambda x: x["label"]), "، ")


def card_sentences(card: DataFrame, keys: list[str], game: str) -> DataFrame:
    """(keys, summary, audience): what a scorecard's trends (place, category, trend) say, and for whom; ``game``: the key that names it."""
    of = card.groupBy(*keys).agg(
        _labels(F.col("trend") == "positive").alias("positive"), _labels(F.col("trend") == "negative").alias("negative"), _labels(~F.col("trend").isin("positive", "negative")).alias("other")
    )
    told = lambda kind, around, lead=None: F.when(F.col(kind) != "", F.concat(*([lead] if lead is not None else []), F.lit(around[0]), F.col(kind), F.lit(around[1])))
    summary = F.concat_ws(" ", *(told(kind, V.TREND_SENTENCES[kind]) for kind in ("positive", "negative", "other")))
    audience = F.concat_ws(" ", told("positive", V.AUDIENCE_SENTENCES["positive"], F.col(game)), told("negative", V.AUDIENCE_SENTENCES["negative"]))
    neither = F.concat(F.lit(V.AUDIENCE_SENTENCES["none"][0]), F.col(game), F.lit(V.AUDIENCE_SENTENCES["none"][1]))
    return of.select(*keys, summary.alias("summary"), F.coalesce(text.or_null(audience), neither).alias("audience"))


def site_differences(sources: DataFrame, points: DataFrame, keys: list[str], wide: float = 1.5) -> DataFrame:
    """(keys, text): how far the scores of sources (source_no, site_name, url, original_score, review_score_10) are apart, and a table
    row for each with a point of its own: its verdict, else its first weakness, else its first strength."""
    order = F.array(F.lit("verdict"), F.lit("negatives"), F.lit("positives"))
    first = points.filter(F.col("section").isin("verdict", "negatives", "positives") & (text.clean_unescaped(F.col("point_fa")) != ""))
    first = first.groupBy(*keys, "source_no").agg(F.min_by(text.clean_unescaped(F.col("point_fa")), F.struct(F.array_position(order, F.col("section")), "pos")).alias("highlight"))
    name = F.coalesce(text.or_null(text.clean_unescaped(F.col("site_name"))), F.lit(UNKNOWN_SITE))
    site = F.when(F.trim(text.blank(F.col("url"))) != "", F.concat(F.lit("["), name, F.lit("]("), F.trim("url"), F.lit(")"))).otherwise(name)
    shown = F.coalesce(text.clean_unescaped(F.col("original_score")), F.lit(V.NO_SCORE))
    shown = F.when(F.col("original_score").isNull(), V.NO_SCORE).otherwise(shown)
    row = F.concat(F.lit("| "), site, F.lit(" | "), shown, F.lit(" | "), F.replace(F.coalesce("highlight", F.lit(V.NO_HIGHLIGHT)), F.lit("|"), F.lit("/")), F.lit(" |"))
    score = scores.as_10(F.col("review_score_10").cast("string"))
    of = sources.join(first, [*keys, "source_no"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("source_no", row.alias("row")))).alias("rows"), F.count(score).alias("n"), F.bround(F.max(score) - F.min(score), 1).alias("spread"))
    far, between, near = V.SPREAD_SENTENCES
    lead = F.when(F.col("n") >= 2, F.concat(F.when(F.col("spread") >= wide, F.concat(F.lit(far), F.col("spread").cast("string"), F.lit(between))).otherwise(near), F.lit("\n\n"))).otherwise("")
    return of.select(*keys, F.concat(lead, F.lit("| منبع | نمره | نکته‌ی متمایزکننده |\n|---|---:|---|\n"), F.array_join(F.col("rows.row"), "\n")).alias("text"))
