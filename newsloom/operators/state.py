"""Items and their lifecycle: schemas, insert-or-ignore, upsert, transitions, look-back windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import dates, text, url

ITEMS = (
    "id string, source_name string, title_en string, title_norm string, snippet_en string, url string, published_at string, published_ts bigint, "
    "created_at timestamp, status string, wp_post_id bigint, retry_count int, next_retry_at timestamp, last_error string"
)
STATE = "key string, value string"
DEFAULTS = {"retry_count": 0}

MAX_RETRIES = 3
BACKOFF_MINUTES = 45
WINDOW_HOURS = 48
RECENT_LIMIT = 300


def evolve(items: DataFrame) -> DataFrame:
    """An older table in today's schema: missing columns are added, with their defaults."""
    schema = items.sparkSession.createDataFrame([], ITEMS).schema
    have = set(items.columns)
    return items.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(DEFAULTS.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema))


def from_entries(entries: DataFrame, run_ts: Column) -> DataFrame:
    """New items of feed entries (source_name, pos, link, title, summary, description, published, updated)."""
    link = text.trim(text.blank(F.col("link")))
    first = lambda a, b: F.coalesce(text.or_null(text.blank(F.col(a))), text.blank(F.col(b)))
    written = text.or_null(text.trim(first("published", "updated")))
    title = text.clean_text(F.col("title"))
    published = F.coalesce(written, F.date_format(run_ts, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return entries.filter(link != "").select(
        url.url_hash(link).alias("id"), "source_name", title.alias("title_en"), text.normalize_title(title).alias("title_norm"), text.clean_text(first("summary", "description")).alias("snippet_en"),
        link.alias("url"), published.alias("published_at"), dates.published_ts(published, run_ts).alias("published_ts"), run_ts.alias("created_at"), F.lit("pending").alias("status"),
        F.lit(None).cast("bigint").alias("wp_post_id"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("next_retry_at"), F.lit(None).cast("string").alias("last_error"), "pos",
    )


def insert_or_ignore(items: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """Rows of ``new`` whose id the table has not: the first of each id wins, now and later."""
    w = Window.partitionBy("id").orderBy(*order)
    first = new.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return first.join(items.select("id"), "id", "left_anti")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value) after (key, value, seq) changes: the last of each key, else what was there."""
    return state.select("key", "value", F.lit(-1).cast("bigint").alias("seq")).unionByName(changes.select("key", "value", "seq")).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def get(state: DataFrame, key: str, default: str) -> DataFrame:
    return state.filter(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def fold_events(items: DataFrame, events: DataFrame, max_retries: int = MAX_RETRIES, backoff_minutes: int = BACKOFF_MINUTES, terminal_failures: bool = False) -> DataFrame:
    """Items after their events (item_id, seq, event in posted/skipped/failed, wp_post_id, reason, at).

    Everything folds with partial aggregation: the last event decides the status, failures add up, and
    the last failure sets the error, the last that is tried again the cooldown. ``terminal_failures``: a failure is final.
    """
    failed = F.col("event") == "failed"
    last = events.groupBy("item_id").agg(
        F.max_by("event", "seq").alias("_event"),
        F.count_if(failed).alias("_failures"),
        F.max_by("wp_post_id", F.when(F.col("event") == "posted", F.col("seq"))).alias("_post"),
        F.max_by("reason", F.when(failed, F.col("seq"))).alias("_reason"),
        F.max(F.when(failed, F.col("seq"))).alias("_any"),
    )
    limit = 0 if terminal_failures else max_retries
    # no more than the first failures that were to be tried again are held of an item
    w = Window.partitionBy("item_id").orderBy("seq")
    first = events.filter(failed).select("item_id", "seq", "at").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit)
    tried = first.groupBy(F.col("item_id").alias("_item")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "at"))), lambda x: x["at"]).alias("_ats"))
    folded = items.join(last, items["id"] == last["item_id"], "left").join(tried, items["id"] == tried["_item"], "left").drop("item_id", "_item")
    retries = F.coalesce("retry_count", F.lit(0)) + F.coalesce("_failures", F.lit(0))
    status = F.when(F.col("_event") == "failed", F.when(retries <= limit, "pending").otherwise("failed")).otherwise(F.coalesce("_event", "status"))
    # only failures that were to be tried again set a cooldown; a final one leaves the last
    cooling = F.least(F.size("_ats"), F.lit(limit) - F.coalesce("retry_count", F.lit(0)))
    cooled = F.when(cooling >= 1, F.get("_ats", cooling - 1) + F.make_interval(mins=F.lit(backoff_minutes))).otherwise(F.col("next_retry_at"))
    return folded.select(
        *(c for c in items.columns if c not in ("status", "wp_post_id", "retry_count", "next_retry_at", "last_error")),
        status.alias("status"), F.coalesce("_post", "wp_post_id").alias("wp_post_id"), retries.cast("int").alias("retry_count"), cooled.alias("next_retry_at"),
        F.when(F.col("_any").isNotNull(), F.substring(F.coalesce("_reason", F.lit("")), 1, 500)).otherwise(F.col("last_error")).alias("last_error"),
    )


def finished(items: DataFrame) -> DataFrame:
    """Posted or skipped items of any time."""
    return items.filter(F.col("status").isin("posted", "skipped")).select("id", "source_name", F.coalesce("title_norm", F.lit("")).alias("title_norm"), F.coalesce("published_ts", F.lit(0)).alias("published_ts"))


def recent(items: DataFrame, run_ts: Column, hours: int = WINDOW_HOURS, limit: int | None = RECENT_LIMIT) -> DataFrame:
    """Posted or skipped items published within the window, the newest ``limit`` of them (a top-k, not a sort), or all."""
    cutoff = F.unix_seconds(run_ts) - hours * 3600
    found = finished(items).filter(F.col("published_ts") >= cutoff)
    return found if limit is None else found.orderBy(F.desc("published_ts"), "id").limit(limit)


def due(items: DataFrame, run_ts: Column) -> DataFrame:
    return items.filter((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= run_ts)))


def next_pending(items: DataFrame, run_ts: Column | None) -> DataFrame:
    """The newest item that is due, of every source at once. Without a time, as in the first generation, a cooldown does not count."""
    from .ordered import first_of_each

    waiting = items.filter(F.col("status") == "pending") if run_ts is None else due(items, run_ts)
    return first_of_each(waiting, ["source_name"], F.coalesce("published_ts", F.lit(0)).desc(), F.desc("created_at"), "id")
