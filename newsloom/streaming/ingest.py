"""A streaming mirror of ingestion: entries to items, each id once, and hourly counts.

Files are taken as they come (``availableNow`` for a run over what is there). State is bounded by the
watermark: an id is remembered as long as its event time may still come; ``append_new`` looks the others up in the
table, so an id never comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import text, url


def entries(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def new_items(stream: DataFrame, delay: str = "48 hours") -> DataFrame:
    """(source_name, link, title, at) entries as items, the first of each canonical url within the delay."""
    items = stream.filter(text.trim(text.blank(F.col("link"))) != "").select(
        url.url_hash(F.col("link")).alias("id"), "source_name", text.clean_text(F.col("title")).alias("title_en"), text.normalize_title(F.col("title")).alias("title_norm"), F.col("link").alias("url"), F.col("at").cast("timestamp").alias("at")
    )
    return items.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def append_new(stream: DataFrame, table: str, checkpoint: str, delay: str = "48 hours") -> StreamingQuery:
    """Append items to a Parquet table, each id once for ever: what the watermark has forgotten is looked up in the table itself.

    A batch that is run again after a failure finds its own rows there, so it adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("id").agg(F.min_by(F.struct(*(c for c in batch.columns if c != "id")), "at").alias("_row")).select("id", "_row.*")
        try:
            known = spark.read.schema(batch.schema).parquet(table).select("id")
        except AnalysisException as e:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "id string")
        first.join(known, "id", "left_anti").select(*batch.columns).write.mode("append").parquet(table)

    return new_items(stream, delay).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events by hour and kind; an hour is given out when the watermark has passed it."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def write(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, over all that is there."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
