"""Shared parts of the training-data operators: words, hashes, materialised tables, table access."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

#: Rows of one Arrow batch; with texts of up to some hundred KB this bounds a Python worker's memory.
BATCH_ROWS = 512

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package where the cluster has not installed it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    # Workers give memory back when a batch is done: several share an executor's.
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the shared folder's owner clears it
        pass


def materialize(df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, and have the driver drop what shuffles have left behind."""
    for df in frames:
        if path := getattr(df, "_written_to", None):
            _delete(df.sparkSession, path)
    gc.collect()
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def crc_text(column) -> "F.Column":
    """crc32 of a column's text form, as zlib.crc32 gives it."""
    return F.crc32(F.encode(column.cast("string"), "utf-8"))


def crc_mod(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) over an array of uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of text, A-Z lower-cased, in order."""
    if not text:
        return np.empty(0, np.uint64)
    found = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() is ASCII only
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of runs of `size` words; with fewer words the whole sequence is one; without words none. In order, with repeats."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
        for i in range(k):  # odd factors, one for each place
            h += words[i : n - k + 1 + i] * np.uint64((0xD6E8FEB86659FD93 + 0x5851F42D4C957F2E * i) & 0xFFFFFFFFFFFFFFFF)
    return mix(h)
