"""New transcripts as a stream of files: split into pages as they arrive, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators.pages import split_pages

SCHEMA = "doc_id long, filename string, format string, nb_pages long, text string"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def page_stream(spark: SparkSession, folder: str, to: str, checkpoint: str) -> StreamingQuery:
    """Append the pages of all files not seen yet to the table at `to`, then end; a later call goes on from there."""
    return split_pages(arriving(spark, folder), ["doc_id", "filename"]).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
