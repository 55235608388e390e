"""An extension: search over notes as they arrive, as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import search_lines


def note_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Notes (path, content) of a folder of Markdown files, new files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", F.col("content").cast("string").alias("content"))


def stream_search(notes: DataFrame, query: str) -> DataFrame:
    """The matching lines of a stream of notes; stateless, so each note is searched once."""
    return search_lines(notes, query)
