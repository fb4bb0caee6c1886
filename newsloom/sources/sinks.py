"""Sinks: keyed tables, evidence caches, dossiers, post drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import text


def publish_drafts(drafts: DataFrame, posts: DataFrame) -> DataFrame:
    """Drafts that may be created: of each (game, platform) key one, none that a post has by slug or key.

    ``drafts``: draft_key, slug, title, status, created_at; only the status ``draft`` passes.
    """
    first = Window.partitionBy("draft_key").orderBy("created_at", "slug")
    one = drafts.filter(F.col("status") == "draft").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    taken_key, taken_slug = posts.select("draft_key").distinct(), posts.select("slug").distinct()
    return one.join(taken_key, "draft_key", "left_anti").join(taken_slug, "slug", "left_anti")


def draft_slug(game, platform):
    """``review-<game>-<platform>``, at most 180 characters."""
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(text.clean_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.concat(F.lit("review-"), slug(game), F.lit("-"), slug(platform)), 1, 180)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; a reader sees the old folder or the new one whole."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_items(items: DataFrame, path: str) -> None:
    """Items in folders by status, sorted by source and time within their files, so that scans of what is pending, or of a window, skip the rest."""
    items.repartition("status", "source_name").sortWithinPartitions("source_name", "published_ts").write.partitionBy("status").mode("overwrite").parquet(path)


def upsert_table(changes: DataFrame, root: str, keys: list[str], order: str) -> DataFrame:
    """A keyed table after changes: of each key the row with the greatest ``order``; the table as it is then.

    Each call writes a new version beside the old one, which stays as it is until the new one is complete, so a failed call
    changes nothing and a reader never meets half a table. Versions before the last two are removed.
    """
    spark = changes.sparkSession
    versions = _versions(spark, root)
    old = spark.read.schema(changes.schema).parquet(f"{root}/v={versions[-1]}") if versions else spark.createDataFrame([], changes.schema)
    every = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in changes.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_row")).select(*keys, "_row.*").select(*changes.columns)
    path = f"{root}/v={(versions[-1] if versions else 0) + 1}"
    last.write.mode("overwrite").parquet(path)
    fs, jvm = _files(spark, root), spark._jvm
    for v in versions[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/v={v}"), True)
    return spark.read.schema(changes.schema).parquet(path)


def read_table(spark, root: str) -> DataFrame:
    """The last complete version of a keyed table."""
    return spark.read.parquet(f"{root}/v={_versions(spark, root)[-1]}")


def _files(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark, root: str) -> list[int]:
    """Versions that were written to their end."""
    fs, at = _files(spark, root), spark._jvm.org.apache.hadoop.fs.Path
    found = fs.globStatus(at(f"{root}/v=*/_SUCCESS")) or []
    return sorted(int(x.getPath().getParent().getName()[2:]) for x in found)


def write_keyed_json(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON for each key; only the folders of keys that are in ``df`` are replaced, each whole."""
    df.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_documents(df: DataFrame, path: str, name: str, body: str) -> None:
    """One text for each name, as a folder of that name: previews, dossiers, reports."""
    safe = F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}._-]+", "-")), "^-+|-+$", "")
    df.select(F.coalesce(text.or_null(safe), F.lit("untitled")).alias("name"), F.col(body).alias("value")).write.partitionBy("name").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def media_rows(images: DataFrame) -> DataFrame:
    """What is sent for an image: file name, type and alternative text, of accepted images (name, ext, alt, fallback_alt, accepted) only."""
    mime = F.when(F.col("ext").isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), F.col("ext")))
    alt = F.substring(F.coalesce(text.or_null(text.clean_text(F.col("alt"))), text.clean_text(F.col("fallback_alt"))), 1, 140)
    return images.filter("accepted").select("name", mime.alias("mime"), alt.alias("alt_text"))


def seo_meta(title: Column, description: Column, keyword: Column) -> Column:
    """map<string, string> of a post's metadata for search; empty ones are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.trim(text.blank(v)).alias("value")) for k, v in (("rank_math_title", title), ("rank_math_description", description), ("rank_math_focus_keyword", keyword))))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] != ""))


def seo_summary(title: Column, description: Column, keyword: Column, n_links: Column) -> Column:
    """One line for the log."""
    return F.format_string("title %d chars | description %d chars | keyword %s | %d links", F.length(text.blank(title)), F.length(text.blank(description)), F.coalesce(text.or_null(F.trim(text.blank(keyword))), F.lit("-")), n_links)
