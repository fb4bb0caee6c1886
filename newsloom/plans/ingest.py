"""Queries of sources, state, lifecycle, ranking and duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, url
from newsloom.operators import ordered, similarity, state
from newsloom.sources import readers

from .base import Rows, query, s_canonical, s_title, s_tokens, s_trim, table
from .scalars import FIRST_LINE, SPELLED, spelled

RUN = "TIMESTAMP '2024-01-31 00:00:00'"


def run_ts():
    return F.expr(RUN)


# --- sources ------------------------------------------------------------------------------------


@query("s2_feed_head", "SELECT event_type AS source_name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 10")
def s2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ordered.top_of_each(e, ["event_type"], 10, F.desc("ts"), "event_id").select(F.col("event_type").alias("source_name"), "event_id")


SETTINGS = Rows("id int, rotation string", [(1, "a, b ,,c"), (2, ""), (3, " solo ")])


@query("s4_rotation", f"SELECT id, CAST(i - 1 AS INTEGER) AS pos, trim(x) AS source_name FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, list_filter(string_split(rotation, ','), lambda x: trim(x) <> '') AS l FROM {SETTINGS.sql()}))")
def s4(spark, sf_dir):
    kept = F.filter(F.split("rotation", ","), lambda x: F.trim(x) != "")
    return SETTINGS.df(spark).select("id", F.posexplode(kept).alias("pos", "x")).select("id", "pos", F.trim("x").alias("source_name"))


LINKS = Rows("line_no int, line string", [(1, "https://a.com/1"), (2, "  "), (3, "# note"), (4, "https://b.com/2 "), (5, "https://a.com/1"), (6, "https://c.com/3")])


@query("s5_manual_links", f"SELECT min(line_no) AS line_no, l AS url FROM (SELECT line_no, {s_trim('line')} AS l FROM {LINKS.sql()}) WHERE l <> '' AND NOT starts_with(l, '#') GROUP BY l")
def s5(spark, sf_dir):
    return readers.manual_links(LINKS.df(spark)).select("line_no", "url")


@query("x6_remaining_links", f"SELECT line_no, l AS url FROM (SELECT min(line_no) AS line_no, {s_trim('line')} AS l FROM {LINKS.sql()} GROUP BY 2) WHERE l NOT IN ('', '# note', 'https://b.com/2')")
def x6(spark, sf_dir):
    links = readers.manual_links(LINKS.df(spark)).select("line_no", "url")
    return links.join(spark.createDataFrame([("https://b.com/2",)], "url string"), "url", "left_anti").select("line_no", "url")


# --- state --------------------------------------------------------------------------------------

#: a lifecycle over events: users are sources, event types transitions
ITEMS_SQL = """(SELECT CAST(event_id AS VARCHAR) AS id, 'u' || CAST(user_id % 20 AS VARCHAR) AS source_name, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'posted' WHEN 'purchase' THEN 'skipped' ELSE 'pending' END AS status,
  CAST(floor(epoch(ts)) AS BIGINT) AS published_ts, ts AS created_at, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 45 MINUTE END AS next_retry_at, event_type || ' of the ' || CAST(user_id AS VARCHAR) AS title_norm FROM events)"""


def items(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("source_name"),
        F.when(kind == "click", "pending").when(kind == "view", "posted").when(kind == "purchase", "skipped").otherwise("pending").alias("status"),
        F.unix_seconds(ts).alias("published_ts"), ts.alias("created_at"), F.when(F.col("event_id") % 7 == 0, ts + F.expr("INTERVAL 45 MINUTE")).alias("next_retry_at"),
        F.concat(kind, F.lit(" of the "), F.col("user_id").cast("string")).alias("title_norm"),
    )


@query("q14_recent_window", f"SELECT id, source_name, title_norm, published_ts FROM {ITEMS_SQL} WHERE status IN ('posted', 'skipped') AND coalesce(published_ts, 0) >= epoch({RUN}) - 48 * 3600 ORDER BY published_ts DESC, id LIMIT 300")
def q14(spark, sf_dir):
    return state.recent(items(spark, sf_dir), run_ts()).select("id", "source_name", "title_norm", "published_ts")


@query("q15_next_pending", f"SELECT source_name, id, published_ts FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY coalesce(published_ts, 0) DESC, created_at DESC, id) AS r FROM {ITEMS_SQL} WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {RUN})) WHERE r = 1")
def q15(spark, sf_dir):
    return state.next_pending(items(spark, sf_dir), run_ts()).select("source_name", "id", "published_ts")


def _turns(spark, sf_dir) -> DataFrame:
    rotation = spark.range(20).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("source_name"), F.col("id").cast("int").alias("pos"))
    turns = ordered.round_robin(state.due(items(spark, sf_dir), run_ts()), rotation, 7, F.desc("published_ts"), F.desc("created_at"), "id")
    return turns.select("id", "source_name", F.col("round").cast("int").alias("round"), F.col("place").cast("int").alias("place"))


@query(
    "r3_round_robin",
    f"""SELECT id, source_name, CAST(row_number() OVER (PARTITION BY source_name ORDER BY published_ts DESC, created_at DESC, id) - 1 AS INTEGER) AS round, CAST((CAST(substr(source_name, 2) AS INTEGER) + 20 - 7) % 20 AS INTEGER) AS place
    FROM {ITEMS_SQL} WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {RUN})""",
)
def r3(spark, sf_dir):
    """Every turn of every source."""
    return _turns(spark, sf_dir)


@query(
    "q8_insert_ignore",
    f"""WITH n AS (SELECT sha256({s_canonical('url')}) AS id, page_id, url, row_number() OVER (PARTITION BY {s_canonical('url')} ORDER BY page_id) AS r FROM {SPELLED}),
    old AS (SELECT sha256({s_canonical('url')}) AS id FROM pages WHERE page_id % 5 = 0) SELECT id, page_id, url FROM n WHERE r = 1 AND id NOT IN (SELECT id FROM old)""",
)
def q8(spark, sf_dir):
    new = spelled(spark, sf_dir).withColumn("id", url.url_hash(F.col("url")))
    old = table(spark, sf_dir, "pages").filter(F.col("page_id") % 5 == 0).select(url.url_hash(F.col("url")).alias("id"))
    return state.insert_or_ignore(old, new, "page_id").select("id", "page_id", "url")


@query(
    "q7_state_upsert",
    "WITH c AS (SELECT 'k' || CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id AS seq FROM events), l AS (SELECT key, arg_max(value, seq) AS value FROM c GROUP BY key) SELECT * FROM l UNION ALL SELECT 'rr_index', '3' UNION ALL SELECT 'default', 'none'",
)
def q7(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    before = spark.createDataFrame([("rr_index", "3"), ("k1", "old")], state.STATE)
    missing = state.get(before, "nothing", "none").select(F.lit("default").alias("key"), "value")
    return state.upsert(before, e).union(missing)


def _lifecycle(e: DataFrame, happened: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    log = happened.select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.when(kind == "view", "posted").when(kind == "purchase", "skipped").otherwise("failed").alias("event"),
        F.col("event_id").alias("wp_post_id"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reason"), F.col("ts").cast("timestamp").alias("at"),
    )
    start = e.select(F.col("user_id").alias("id")).distinct().selectExpr("id", "'pending' AS status", "CAST(NULL AS BIGINT) AS wp_post_id", "0 AS retry_count", "CAST(NULL AS TIMESTAMP) AS next_retry_at", "CAST(NULL AS STRING) AS last_error")
    out = state.fold_events(start, log)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return out.select("id", "status", shown(F.col("wp_post_id")).alias("wp_post_id"), "retry_count", shown(F.unix_seconds("next_retry_at")).alias("next_retry"), shown(F.col("last_error")).alias("last_error"))


@query(
    "st2_lifecycle",
    """WITH e AS (SELECT user_id AS item_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'posted' WHEN 'purchase' THEN 'skipped' ELSE 'failed' END AS event, ts AS happened, 'r' || CAST(event_id AS VARCHAR) AS reason FROM events),
    a AS (SELECT item_id, arg_max(event, seq) AS last, count(*) FILTER (event = 'failed') AS failures, max(seq) FILTER (event = 'posted') AS post, arg_max(reason, seq) FILTER (event = 'failed') AS reason FROM e GROUP BY item_id),
    f AS (SELECT item_id, happened FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY item_id) AS n FROM e WHERE event = 'failed') WHERE k = least(n, 3))
    SELECT CAST(a.item_id AS BIGINT) AS id, CASE WHEN last = 'failed' THEN CASE WHEN failures <= 3 THEN 'pending' ELSE 'failed' END ELSE last END AS status, coalesce(CAST(post AS VARCHAR), '') AS wp_post_id, CAST(failures AS INTEGER) AS retry_count,
    coalesce(CAST(CAST(floor(epoch(happened + INTERVAL 45 MINUTE)) AS BIGINT) AS VARCHAR), '') AS next_retry, coalesce(reason, '') AS last_error FROM a LEFT JOIN f USING (item_id)""",
)
def st2(spark, sf_dir):
    """The fold of the whole event log."""
    e = table(spark, sf_dir, "events")
    return _lifecycle(e, e)


@query("q4_schema_evolution", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, 0 AS retry_count, '' AS last_error, 14 AS n_columns FROM orders")
def q4(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    new = state.evolve(old)
    return new.select("id", "status", "retry_count", F.coalesce("last_error", F.lit("")).alias("last_error"), F.lit(len(new.columns)).alias("n_columns"))


@query("q3_schema", "SELECT * FROM (VALUES ('id', 'string'), ('retry_count', 'int'), ('published_ts', 'bigint')) AS t(name, kind)")
def q3(spark, sf_dir):
    return spark.createDataFrame([(n, k) for n, k in spark.createDataFrame([], state.ITEMS).dtypes if n in ("id", "retry_count", "published_ts")], "name string, kind string")


# --- duplicates ---------------------------------------------------------------------------------


def _titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.normalize_title(F.substring_index("text", "\n", 1)).alias("title_norm"))


@query(
    "j2_candidates",
    f"""WITH t AS (SELECT doc_id AS id, {s_title(FIRST_LINE)} AS n FROM documents), k AS (SELECT id, list_distinct({s_tokens('n')}) AS t FROM t WHERE len({s_tokens('n')}) >= 5)
    SELECT a.id AS new_id, b.id AS old_id FROM k a JOIN k b ON a.id > b.id WHERE len(list_intersect(a.t, b.t)) >= (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) * 0.95""",
)
def j2_candidates(spark, sf_dir):
    """The set-join part of the title join, which SQL can express: token Jaccard of 0.95 or more."""
    return similarity.same_tokens(_titles(spark, sf_dir))


@query("j2_duplicates")
def j2(spark, sf_dir):
    """Each title's best match among earlier ones, at the production threshold."""
    return similarity.best_earlier(_titles(spark, sf_dir)).select(F.col("id").alias("doc_id"), "best_id", "score")


@query("st4_sequential_duplicates")
def st4(spark, sf_dir):
    """Titles that an earlier one is like, in the order of processing."""
    return similarity.with_earlier(_titles(spark, sf_dir)).select(F.col("id").alias("doc_id"))
