"""A growing corpus folder as a stream: each new file is parsed once. Documents are independent, so no state is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse
from ..sources.corpus import decode


def watch_directory(spark: SparkSession, root: str, pattern: str = "*.txt", encoding: str = "auto", files_per_trigger: int = 1000) -> DataFrame:
    """``path, modified, source`` of files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), decode(F.col("content"), encoding).alias("source"))


def parse_stream(stream: DataFrame, parts: Sequence[str], source: str = "source") -> DataFrame:
    return parse(stream, parts, source)


def diagnostic_counts(stream: DataFrame, time: str = "modified", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Diagnostics by kind and window of file time; rows later than the watermark are dropped."""
    found = parse(stream, ["diagnostics"]).select(time, F.explode("parsed.diagnostics").alias("d"))
    return found.withWatermark(time, late).groupBy(F.window(time, window), F.col("d.kind").alias("kind")).count()


def write_parsed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet folder with its own checkpoint, and gives the rows."""
    write_parsed(stream, f"{folder}/rows", f"{folder}/progress").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
