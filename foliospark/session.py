"""Session settings that the library's results rest on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",  # data URIs must not hold line breaks
    # Files may have some hundred MB: a worker holds few of them at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS, and let Python workers import the package where the cluster has not installed it."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
