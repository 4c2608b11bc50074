"""Files to Markdown: native routing, one Python pass, native front matter and statistics.

The path of a file's row: `sources.files` reads it; `route` settles by name, size and first bytes what needs no
parsing; `converted` runs the parser once per file and keeps its result as columns; `finished` adds front matter, counts and names natively.
A file that can't be converted is a row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import markdown as md
from foliospark.parse.convert import SHORTCUTS, SIZE_LIMIT, SUPPORTED
from foliospark.parse.office import Options
from foliospark.session import prepare

SCHEMA = "name string, format string, label string, markdown string, meta array<struct<k:string,v:string>>, warnings array<string>, image_count int, error string"


def route(files: DataFrame) -> DataFrame:
    """files with early_error (too large, or only a link) and is_markdown (opened as it is, not converted)."""
    ext = md.extension("name")
    early = F.when(F.col("length") > SIZE_LIMIT, f"Files of over {SIZE_LIMIT >> 20} MB are not converted.").when(ext.isin(*SHORTCUTS), F.concat(F.lit("Only a pointer to an online document is stored in a ."), ext, F.lit(" file.")))
    return files.withColumns({"early_error": early, "is_markdown": F.col("name").rlike(md.MARKDOWN_NAME)})


def quick_format(head, name):
    """The format that the first bytes and the name alone settle; null where the whole file has to be looked at."""
    ext, starts = md.extension(name), lambda h: F.startswith(head, F.unhex(F.lit(h)))
    return (
        F.when(starts("25504446"), "pdf")
        .when(starts("7B5C727466"), "rtf")
        .when(starts("504B"), None)
        .when(starts("89504E47") | starts("FFD8FF") | starts("47494638") | starts("424D"), "image")
        .when(ext.isin("eml", "mht", "mhtml"), "eml")
        .when(ext.isin("csv", "tsv"), "csv")
        .when(ext.isin("html", "htm", "xhtml"), "html")
    )


def offered(files: DataFrame) -> DataFrame:
    """The files whose extension a file picker offers; all others can be converted too."""
    return files.where(md.extension("name").isin(*SUPPORTED))


def detected(files: DataFrame) -> DataFrame:
    """name, format of each row of files (name, content, length); only what the first bytes and the name leave open goes to Python. Null where there is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from foliospark.parse.convert import Refused, detect

        for batch in batches:
            found = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    found.append(detect(name, bytes(content or b""))[0])
                except Refused:
                    found.append(None)
            yield pd.DataFrame({"name": batch["name"], "format": pd.Series(found, dtype=object)})

    prepare(files.sparkSession)
    routed = route(files).withColumn("format", F.when(F.col("early_error").isNull(), quick_format(F.substring("content", 1, 16), F.col("name"))))
    known = routed.where("format is not null or early_error is not null").select("name", "format")
    return known.unionByName(routed.where("format is null and early_error is null").select("name", "content").mapInPandas(run, "name string, format string"))


def converted(files: DataFrame, options: Options | None = None) -> DataFrame:
    """name and the parser's result for each row of files (name, content)."""
    options = options or Options()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from foliospark.parse.convert import run as convert

        for batch in batches:
            found = [(n, convert(n, bytes(c or b""), options)) for n, c in zip(batch["name"], batch["content"], strict=True)]
            yield pd.DataFrame({"name": [n for n, _ in found], **{k: [f[k] for _, f in found] for k in ("format", "label", "markdown")}, "meta": [[{"k": k, "v": v} for k, v in f["meta"].items()] for _, f in found], "warnings": [f["warnings"] for _, f in found], "image_count": [f["images"] for _, f in found], "error": [f["error"] for _, f in found]})

    prepare(files.sparkSession)
    return files.select("name", "content").mapInPandas(run, SCHEMA)


def finished(results: DataFrame, options: Options | None = None, moment: str | None = None) -> DataFrame:
    """results with their documents: front matter before the Markdown, output name and word count; moment stands as `converted`."""
    options = options or Options()
    title = F.try_element_at(F.filter("meta", lambda e: e["k"] == "title"), F.lit(1))["v"]
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    head = F.array(entry("title", F.coalesce(title, md.title_from_name("name"))), entry("source_file", F.col("name")), entry("source_format", F.col("label")), entry("converted", F.lit(moment or "")))
    front = md.front_matter(F.concat(head, F.filter("meta", lambda e: e["k"] != "title")))
    body = F.concat(front, F.lit("\n\n"), F.col("markdown")) if options.front_matter else F.col("markdown")
    return results.withColumns({"output_name": md.output_name("name"), "word_count": md.count_words("markdown"), "document": F.when(F.col("error").isNull(), body)})


def convert_files(files: DataFrame, options: Options | None = None, moment: str | None = None) -> DataFrame:
    """One row for each file, whatever becomes of it."""
    routed = route(files)
    refused = routed.where("early_error is not null").select("name", *(F.lit(None).cast(t).alias(c) for c, t in (("format", "string"), ("label", "string"), ("markdown", "string"))), F.array().cast("array<struct<k:string,v:string>>").alias("meta"), F.array().cast("array<string>").alias("warnings"), F.lit(0).alias("image_count"), F.col("early_error").alias("error"))
    return finished(converted(routed.where("early_error is null"), options).unionByName(refused), options, moment)
