"""Annotation of documents that arrive: the stateless operators, such as segmentation.token_table(), run on streams as they are; counts are kept by event-time windows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; only local sessions may go without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(path or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    """Documents in Parquet files that are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_counts(events: DataFrame, keys: list[str], time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, keys..., n) by tumbling windows; rows later than the watermark are dropped, and with it state."""
    out = events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write a stream as Parquet; the checkpoint lets it go on after a failure without losing or repeating rows."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()
