"""An inbox: files that arrive in a folder are converted once each and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.parse.office import Options
from foliospark.plans.convert import convert_files
from foliospark.sources.files import stream_files


def convert_inbox(spark: SparkSession, inbox: str, out: str, checkpoint: str, options: Options | None = None, files_per_trigger: int = 100) -> StreamingQuery:
    """Start the conversion of what is in the inbox now and comes later; each trigger's results are one Parquet append, exactly once by the checkpoint."""
    results = convert_files(stream_files(spark, inbox, files_per_trigger), options)
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Counts and sums of event values by type over tumbling windows of event time (an extension; no converter needs it)."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
