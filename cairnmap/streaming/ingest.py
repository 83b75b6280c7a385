"""Incremental location of new images: a file stream in place of a resume list (an extension of this engine)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import readers, writers


def image_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (image, polygons) from JSON files that arrive in a folder."""
    return spark.readStream.schema(readers.IMAGE_POLYGONS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def locate_stream(images: DataFrame, locate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``locate`` on each batch of new images and adds its records: each image once, whatever fails.

    Images that this stream has seen are keyed state, kept with the checkpoint.  Images that had records before the stream
    began are written once, beside the checkpoint, as names alone; no batch reads the records.  A batch is written under
    the checkpoint's name and its number: one that was killed, even after it was written, replaces itself when it runs again."""
    spark, known = images.sparkSession, f"{checkpoint.rstrip('/')}-known"
    if readers.first_existing(spark, f"{known}/_SUCCESS") is None:
        readers.records(spark, out).select("image").distinct().write.mode("overwrite").parquet(known)
    before = spark.read.schema("image string").parquet(known)
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        writers.append_records(locate(batch.join(before, "image", "left_anti")), out, f"{name}-{number}")

    new = images.dropDuplicates(["image"])
    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
