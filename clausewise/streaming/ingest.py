"""Source documents as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions import text as X
from clausewise.operators.merge import first_of_each
from clausewise.plans.pipelines import NOISE
from clausewise.sources.sinks import exists


def cleaned_stream(documents: DataFrame) -> DataFrame:
    """The texts of a stream, cleaned, with their hash: stubs and error pages are left out."""
    told = documents.withColumn("clean", X.document_text(F.col("content_text"))).where((F.char_length("clean") >= 30) & ~F.col("content_text").rlike(NOISE))
    return told.select(F.sha2("content_text", 256).alias("content_hash"), F.char_length("clean").alias("n_chars"), F.col("created_at").cast("timestamp").alias("created_at"))


def ingest_available(spark: SparkSession, path: str, schema, out: str, state: str) -> DataFrame:
    """Runs the stream over the Parquet files that are at `path`, a pattern of files or folders, going on from `state`, and returns what lies at `out` after it.

    Each batch adds the texts whose hash is not stored yet, however old or new a row says it is; a batch that runs again adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = first_of_each(batch, ["content_hash"], "created_at")
        if exists(spark, out):
            new = new.join(spark.read.parquet(out).select("content_hash"), "content_hash", "left_anti")
        new.write.mode("append").parquet(out)

    files = spark.readStream.schema(schema).parquet(path)
    cleaned_stream(files).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def daily_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events by type and day of a stream, late ones up to the watermark included."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
