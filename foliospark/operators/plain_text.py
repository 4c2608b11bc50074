"""Plain text to Markdown as one chain of window functions over lines; no Python touches a line.

A line gets its neighbours by lag and lead, its kind by a CASE, and its block by a running sum of block starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import markdown as md

BULLET = rf"^({md.WS}*)([-*+•·▪◦‣o]){md.WS}+(.+)$"
ORDERED = rf"^({md.WS}*)([0-9]{{1,3}})[.)]{md.WS}+(.+)$"
UNDERLINE = rf"^{md.WS}*(={{3,}}|-{{3,}}|~{{3,}}|\*{{3,}}|_{{3,}}){md.WS}*$"
NAMED_HEADING = rf"(?i)^(chapter|section|part|appendix){md.WS}+[0-9ivx]+"


def split_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n (from 0), line: line ends unified, tabs as four spaces."""
    body = F.replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), F.lit("\t"), F.lit("    "))
    return docs.select(key, F.posexplode(F.split(body, "\n", -1)).alias("n", "line"))


def heading_like(trimmed: Column, next_blank: Column) -> Column:
    letters = F.regexp_replace(trimmed, "[^A-Za-z]", "")
    fits = F.length(trimmed).between(3, 80) & ~trimmed.rlike("[.,;]$")
    return fits & ((next_blank & (F.length(letters) >= 3) & (letters == F.upper(letters))) | trimmed.rlike(NAMED_HEADING))


def classify(lines: DataFrame, key: str) -> DataFrame:
    """key, n, line, kind: blank, title, underline (used up by the title above), rule, bullet, number, heading or prose."""
    w = Window.partitionBy(key).orderBy("n")
    t = md.trim("line")
    over = F.col("line").rlike(UNDERLINE)
    base = lines.withColumns({"t": t, "after": F.coalesce(F.lead("line").over(w), F.lit(""))}).withColumn("rule_like", over)
    # A title needs a line that is not itself used up as the underline of one above. In a run of lines that each could be a
    # title over the next, every second one is: titles alternate from the start of the run.
    can = (F.col("t") != "") & F.col("after").rlike(UNDERLINE) & (F.length("t") <= 120)
    base = base.withColumn("can", can).withColumn("run", F.sum(F.when(F.col("can"), 0).otherwise(1)).over(w))
    in_run = Window.partitionBy(key, "run").orderBy("n")
    place = F.sum(F.when(F.col("can"), 1).otherwise(0)).over(in_run)
    base = base.withColumn("title", F.col("can") & (place % 2 == 1))
    base = base.withColumn("used", F.coalesce(F.lag("title").over(w), F.lit(False)))
    kind = (
        F.when(F.col("used"), "underline")
        .when(F.col("t") == "", "blank")
        .when(F.col("title"), "title")
        .when(F.col("rule_like"), "rule")
        .when(F.col("line").rlike(BULLET), "bullet")
        .when(F.col("line").rlike(ORDERED), "number")
        .when(heading_like(F.col("t"), md.is_blank("after")), "heading")
        .otherwise("prose")
    )
    return base.select(key, "n", "line", "t", "after", kind.alias("kind"))


def to_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text", bullet: str = "-", keep_breaks: bool = False) -> DataFrame:
    """key, markdown for each row of docs; key is unique. Null texts give empty Markdown."""
    lines = classify(split_lines(docs, key, text), key).where("kind <> 'underline'")
    w = Window.partitionBy(key).orderBy("n")
    group = F.when(F.col("kind") == "prose", "p").when(F.col("kind").isin("bullet", "number"), "l").otherwise("x")
    lines = lines.withColumn("group", group)
    starts = (F.col("group") == "x") | (F.col("group") != F.coalesce(F.lag("group").over(w), F.lit("")))
    lines = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("kind <> 'blank'")
    depth = lambda p: F.repeat(F.lit("  "), F.least(F.lit(4), F.floor(F.length(F.regexp_extract("line", p, 1)) / 2).cast("int")))
    item = lambda p: md.escape_block(md.trim(F.regexp_extract("line", p, 3)))
    piece = (
        F.when(F.col("kind") == "title", F.concat(F.when(md.trim("after").startswith("="), "# ").otherwise("## "), md.trim(md.collapse_spaces("t"))))
        .when(F.col("kind") == "rule", "---")
        .when(F.col("kind") == "bullet", F.concat(depth(BULLET), F.lit(f"{bullet} "), item(BULLET)))
        .when(F.col("kind") == "number", F.concat(depth(ORDERED), F.regexp_extract("line", ORDERED, 2), F.lit(". "), item(ORDERED)))
        .when(F.col("kind") == "heading", F.concat(F.when(F.length("t") < 40, "## ").otherwise("### "), md.trim(md.collapse_spaces("t"))))
        .otherwise(md.escape_block("t") if keep_breaks else F.col("t"))
    )
    pieces = lines.select(key, "n", "block", "group", piece.alias("piece"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"])
    blocks = pieces.groupBy(key, "block").agg(F.first("group").alias("group"), ordered.alias("p"))
    prose = F.array_join("p", "  \n") if keep_breaks else md.escape_block(md.trim(F.regexp_replace(F.array_join("p", " "), f"{md.WS}+", " ")))
    blocks = blocks.select(key, "block", F.when(F.col("group") == "p", prose).otherwise(F.array_join("p", "\n")).alias("text"))
    done = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]).alias("blocks"))
    return docs.select(key).join(done, key, "left").select(key, F.when(F.col("blocks").isNull(), "").otherwise(md.join_blocks("blocks")).alias("markdown"))


def subtitles(text) -> Column:
    """Subtitle text (srt or vtt) to Markdown: a bold time span and its words for each cue."""
    body = F.regexp_replace(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "\r\n?", "\n"), "^WEBVTT[^\n]*\n", "")

    def cue(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n", -1), lambda x: ~md.is_blank(x))
        at = F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.contains("-->"), i)), lambda i: i.isNotNull())), F.lit(-1))
        span = F.replace(F.regexp_replace(F.element_at(lines, at + 1), rf"{md.WS}*-->{md.WS}*", " → "), F.lit(","), F.lit("."))
        span = F.array_join(F.slice(F.split(span, " ", -1), 1, 3), " ")
        said = md.trim(F.regexp_replace(F.array_join(F.slice(lines, at + 2, F.size(lines)), " "), "<[^>]+>", ""))
        timed = F.when(said != "", F.concat(F.lit("**"), span, F.lit("**  \n"), md.escape_block(said)))
        return F.when(F.size(lines) == 0, None).when(at < 0, md.trim(md.escape_block(F.array_join(lines, " ")))).otherwise(timed)

    return md.join_blocks(F.filter(F.transform(F.split(body, "\n{2,}", -1), cue), lambda b: b.isNotNull()))
