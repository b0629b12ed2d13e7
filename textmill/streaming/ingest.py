"""Incremental ingestion of page files as they arrive; the engine itself is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill.operators.postings import tag_frequencies


def page_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet page files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def without_copies(pages: DataFrame, time: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """The first of each content among the rows that arrive within ``delay`` of each other, by a digest; later ones may pass.
    State is bounded by the watermark."""
    return pages.withWatermark(time, delay).withColumn("digest", F.sha2(F.coalesce("content", F.lit("")), 256)).dropDuplicatesWithinWatermark(["digest"])


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of every micro-batch as a run of its own (column ``run_id``) and stop when what is there is read.
    A batch that is repeated after a failure overwrites its own run, so each page counts once."""

    def write(batch: DataFrame, run: int) -> None:
        counted = tag_frequencies(batch, "page_id", "content")
        counted.write.mode("overwrite").parquet(f"{out}/run_id={run}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
