"""An extension: a collection that follows a directory, as a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions.paths import supported
from folioscope.sources.ingest import parse

FILE = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, directory: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the books of files that come into ``directory`` to the Parquet folder ``table``. With ``once`` it stops when all are read.

    Each file is read once; the checkpoint keeps which, and the batch number names the batch's folder, so a batch that is
    repeated after a failure replaces its own rows.
    """
    found = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(directory)
    rows = found.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.lit(directory).alias("root_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")

    def batch(df: DataFrame, number: int) -> None:
        parse(df.where(supported(F.col("file_path")))).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n): events by time window, as a stream or a table; late ones are waited for as long as the watermark says."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
