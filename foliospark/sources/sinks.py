"""Converted documents to files: one Markdown file each, archives of a bounded number, a streaming sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.library import unique_names


def archives(documents: DataFrame, per_archive: int = 1000) -> DataFrame:
    """archive (from 0), content: ZIP files of at most per_archive documents (output_name, document), named apart inside the whole result."""
    kept = documents.where("document is not null")
    named = unique_names(kept.withColumn("__o", F.xxhash64("name", "output_name")), "output_name", "__o", spaced=False)
    placed = named.withColumn("archive", F.floor((F.row_number().over(Window.partitionBy(F.pmod("__o", F.lit(64))).orderBy("__o")) - 1) / per_archive) * 64 + F.pmod("__o", F.lit(64)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        from foliospark.parse.archive import write_zip

        files = sorted(zip(group["unique_name"], group["document"], strict=True))
        return pd.DataFrame({"archive": [int(group["archive"].iloc[0])], "content": [write_zip([(n, d.encode()) for n, d in files])]})

    return placed.select("archive", "unique_name", "document").groupBy("archive").applyInPandas(pack, "archive long, content binary")


def exported(documents: DataFrame, per_archive: int = 1000) -> DataFrame:
    """name, content of what a user is given: the file itself if one document was converted, else archives."""
    kept = documents.where("document is not null")
    if len(kept.select("output_name").head(2)) == 1:
        return kept.select(F.col("output_name").alias("name"), F.encode("document", "utf-8").alias("content"))
    return archives(documents, per_archive).select(F.format_string("documents-%d.zip", "archive").alias("name"), "content")


def write_markdown(documents: DataFrame, folder: str) -> DataFrame:
    """Write each document to a local or mounted folder; gives name and path. Each task writes its own rows, so nothing is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for name, text in zip(batch["unique_name"], batch["document"], strict=True):
                paths.append(os.path.join(folder, name.replace("/", "_")))
                with open(paths[-1], "w", encoding="utf-8") as f:
                    f.write(text)
            yield pd.DataFrame({"name": batch["unique_name"], "path": paths})

    kept = documents.where("document is not null").withColumn("__o", F.xxhash64("name", "output_name"))
    return unique_names(kept, "output_name", "__o", spaced=False).select("unique_name", "document").mapInPandas(run, "name string, path string")
