"""Files as rows (name, path, content, length, modified), in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import prepare


def _named(rows: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("name"), "path", "content", "length", F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Length and path filters on the result reach the listing; content is only read where it's selected."""
    reader = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true")
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Each file once, as the checkpoint remembers what was taken."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _named(prepare(spark).readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path))


def pasted(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Pasted texts as files; such of 40 characters or fewer don't count."""
    kept = [t for t in texts if len(t.strip()) > 40]
    rows = [(f"pasted-{i}.html" if t.lstrip().lower().startswith(("<!doctype html", "<html")) else f"pasted-{i}.txt", None, t.encode(), len(t.encode())) for i, t in enumerate(kept, 1)]
    return prepare(spark).createDataFrame(rows, "name string, path string, content binary, length long").withColumn("modified", F.lit(None).cast("timestamp"))
