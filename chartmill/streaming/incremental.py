"""Structured Streaming over arriving files and points: an extension, as the batch operators have no counterpart there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import variant


def arriving_pdfs(spark: SparkSession, root: str, most_files: int = 100) -> DataFrame:
    """A stream of new PDF files with their content hash and canonical name."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(root)
    out = files.withColumn("digest", F.sha2("content", 256)).withColumns(variant(F.element_at(F.split("path", "/"), -1)))
    return out.drop("content")


def first_of_content(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row a content hash within the watermark."""
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["digest"])


def windowed_charge(points: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """points (curve, ts, y) -> statistics by curve and tumbling window, final once the watermark has passed."""
    w = points.withWatermark("ts", late).groupBy(F.window("ts", window), "curve")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.min("y").alias("low"), F.max("y").alias("high")).select("curve", F.col("window.start").alias("start"), "n", "total", "low", "high")
