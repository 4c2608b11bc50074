"""Markdown documents as rows of blocks and table cells, and editor commands over columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import prepare

BLOCK = "array<struct<kind:string,level:int,info:string,text:string>>"


def blocks(docs: DataFrame, key: str, markdown: str = "markdown") -> DataFrame:
    """key, n (from 0), kind, level, info, text for each block of each document."""
    prepare(docs.sparkSession)

    def parse(texts: pd.Series) -> pd.Series:
        from foliospark.parse.blocks import blocks as of

        return texts.map(lambda t: of(t or ""))

    rows = docs.select(key, F.posexplode(F.pandas_udf(parse, BLOCK)(markdown)).alias("n", "b"))
    return rows.select(key, "n", "b.*")


def table_cells(blocks_: DataFrame, key: str) -> DataFrame:
    """key, n, row, col, value of the tables among blocks: what `operators.tables.render_tables` takes."""
    lines = blocks_.where("kind = 'table'").select(key, "n", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    bare = F.regexp_replace(F.trim("line"), r"^\||(?<!\\)\|$", "")
    cells = lines.select(key, "n", "row", F.posexplode(F.split(bare, r"(?<!\\)\|", -1)).alias("col", "value"))
    return cells.withColumn("value", F.replace(F.trim("value"), F.lit("\\|"), F.lit("|")))


def edited(rows: DataFrame) -> DataFrame:
    """rows of (action, text, start, end) with new_text, new_start, new_end."""
    prepare(rows.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "new_text string, new_start int, new_end int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from foliospark.parse.editing import apply

        for batch in batches:
            done = [apply(a, t, int(s), int(e)) for a, t, s, e in zip(batch["action"], batch["text"], batch["start"], batch["end"], strict=True)]
            yield batch.assign(new_text=[d.text for d in done], new_start=[d.start for d in done], new_end=[d.end for d in done])

    return rows.mapInPandas(run, schema)
