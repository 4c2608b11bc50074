"""Web pages to Markdown and to rows of links, headings and metadata: one Python pass, the rest native."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import markdown as md

RESULT = "struct<markdown:string,title:string,meta:array<struct<k:string,v:string>>,images:int>"


def html_to_markdown(html: pd.Series) -> pd.DataFrame:
    from foliospark.parse.html import to_markdown

    found = [to_markdown(h or "") for h in html]
    return pd.DataFrame({"markdown": [f["markdown"] for f in found], "title": [f["title"] for f in found], "meta": [[{"k": k, "v": v} for k, v in f["meta"].items()] for f in found], "images": [f["images"] for f in found]})


def convert(pages: DataFrame) -> DataFrame:
    """page_id, url, title, markdown, words, images, meta."""
    out = pages.select("page_id", "url", F.pandas_udf(html_to_markdown, RESULT)("html").alias("r"))
    return out.select("page_id", "url", F.col("r.title").alias("title"), F.col("r.markdown").alias("markdown"), md.count_words("r.markdown").alias("words"), F.col("r.images").alias("images"), F.col("r.meta").alias("meta"))


def with_front_matter(converted: DataFrame) -> DataFrame:
    """page_id, document: the converted page behind its front matter."""
    name = F.col("url")
    head = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("title", F.when(F.col("title") != "", F.col("title")).otherwise(md.title_from_name(name))), ("source_file", name), ("source_format", F.lit("HTML")))))
    front = md.front_matter(F.concat(head, F.filter("meta", lambda e: e["k"] != "title")))
    return converted.select("page_id", F.concat(front, F.lit("\n\n"), F.col("markdown")).alias("document"))


def links(converted: DataFrame) -> DataFrame:
    """page_id, n, label, href of the links in converted pages."""
    found = F.regexp_extract_all("markdown", F.lit(r"(?<!!)(\[(?:\\.|[^\[\]\\])*\]\((?:<[^>]*>|[^()\s]*)(?: \"[^\"]*\")?\))"), 1)
    rows = converted.select("page_id", F.posexplode(found).alias("n", "m"))
    href = F.regexp_replace(F.regexp_extract("m", r"\]\((<[^>]*>|[^()\s]*)", 1), "^<|>$", "")
    return rows.select("page_id", "n", md.unescape(F.regexp_extract("m", r"^\[((?:\\.|[^\[\]\\])*)\]", 1)).alias("label"), href.alias("href"))
