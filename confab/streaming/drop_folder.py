"""Streaming ingest of a drop folder (our extension): new transcript files to parsed meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions.text import content_key
from confab.sources.files import transcripts_of_files

from .keyed import first_of_keys


def read_drop_folder(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A stream of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)


def meetings(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """Parsed meetings of a stream of files: a row for every file that fails, and one for each text.

    A text that comes again within that time, in this micro-batch or a later one, is left out.
    ``cache_key`` is null where there is an error, so failed files are never equal.
    """
    rows = transcripts_of_files(stream, keep=("modificationTime",))
    keyed = rows.withColumn("cache_key", F.when(F.col("error").isNull(), content_key(F.col("text"))))
    return first_of_keys(keyed, "cache_key", "modificationTime", within)


def ingest(stream: DataFrame, target: str, checkpoint: str, within: str = "30 days"):
    """Appends the meetings of files to ``target``, each once; runs until what is there has been read."""
    return meetings(stream, within).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def active_speakers(segments: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns per speaker and window of a stream of segments with an event time ``ts``."""
    return segments.withWatermark("ts", late).groupBy(F.window("ts", window), "meeting_id", "speaker_id").agg(F.count("*").alias("turns"))
