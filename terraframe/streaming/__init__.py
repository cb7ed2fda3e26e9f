"""Arrival of prediction files as a stream: the batch parser on a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.operators.archive import box_lines


def arriving_boxes(spark: SparkSession, folder: str, files_per_trigger: int = 10_000) -> DataFrame:
    """Box records of text files as they arrive: file_id is the hash of the path. Stateless, so any sink mode works."""
    f = (spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
         .option("maxFilesPerTrigger", files_per_trigger).load(folder))
    return box_lines(f.select(F.xxhash64("_metadata.file_path").alias("file_id"), F.col("value").alias("content")))
