"""Tables: long cells to aligned Markdown, alignment, delimited text and JSON records.

A cell is a row (keys..., row int, col int, value string). Rendering is one exchange by the keys: column widths, lines and
the final join are aggregates that all cluster by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import markdown as md
from foliospark.parse.delimited import DELIMITERS

#: Most rows of a delimited file that are rendered, its header among them.
ROW_CAP = 5000
#: Most columns of a table made of JSON records.
RECORD_COLUMNS = 24


def infer_alignment(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, right: whether all filled data cells of a column are numeric and there is one; as wide as the first row."""
    v = md.trim("value")
    first = F.min("row").over(Window.partitionBy(*keys))
    by = cells.withColumn("first", first).groupBy(*keys, "col")
    filled = by.agg(
        F.count_if((F.col("row") > F.col("first")) & (v != "")).alias("filled"),
        F.count_if((F.col("row") > F.col("first")) & md.is_numeric_cell("value")).alias("numeric"),
        F.max(F.col("row") == F.col("first")).alias("in_header"),
    )
    return filled.where("in_header").select(*keys, "col", ((F.col("filled") > 0) & (F.col("filled") == F.col("numeric"))).alias("right"))


def render_tables(cells: DataFrame, keys: list[str], align: DataFrame | None = None, escape: bool = True) -> DataFrame:
    """keys, markdown. Ragged rows are padded; the first row is the header; align: keys, col, right."""
    text = md.trim(md.escape_cell("value")) if escape else md.trim("value")
    cells = cells.select(*keys, "row", "col", F.coalesce(text, F.lit("")).alias("value"))
    widths = cells.groupBy(*keys, "col").agg(F.greatest(F.lit(3), F.max(F.length("value"))).alias("width"))
    if align is not None:
        widths = widths.join(align, [*keys, "col"], "left")
    else:
        widths = widths.withColumn("right", F.lit(False))
    frame = widths.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("width", F.coalesce("right", F.lit(False)).alias("right"))))).alias("frame"), F.max("col").alias("last"))
    lines = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    width = lambda c: F.coalesce(F.element_at("frame", c)["width"], F.lit(3))
    across = F.sequence(F.lit(0), F.col("last"))
    dash = lambda n: F.repeat(F.lit("-"), n)
    line = F.concat(F.lit("| "), F.array_join(F.transform(across, lambda c: F.rpad(F.coalesce(F.element_at("cells", c), F.lit("")), width(c), " ")), " | "), F.lit(" |"))
    divider = F.concat(F.lit("| "), F.array_join(F.transform(across, lambda c: F.when(F.coalesce(F.element_at("frame", c)["right"], F.lit(False)), F.concat(dash(F.greatest(width(c) - 1, F.lit(2))), F.lit(":"))).otherwise(dash(width(c)))), " | "), F.lit(" |"))
    drawn = lines.join(frame, keys).select(*keys, "row", line.alias("line"), divider.alias("divider"))
    body = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"), F.first("divider").alias("divider"))
    text = F.transform("lines", lambda x: x["line"])
    rest = F.when(F.size(text) > 1, F.concat(F.lit("\n"), F.array_join(F.slice(text, F.lit(2), F.size(text)), "\n"))).otherwise("")
    return body.select(*keys, F.concat(F.element_at(text, 1), F.lit("\n"), F.col("divider"), rest).alias("markdown"))


def to_cells(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Long cells of a flat table with a header row of the columns' names; row numbers follow `order` inside the keys."""
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = numbered.select(*keys, "row", F.posexplode(F.array(*as_text)).alias("col", "value"))
    head = rows.select(*keys).distinct().select(*keys, F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, columns))).alias("col", "value"))
    return head.unionByName(body)


# -------------------------------------------------------------- delimited text


def sniff_delimiter(text) -> Column:
    """The delimiter with the best score over the first 8192 characters and 20 lines: mean * n - 2 * variance of the non-zero counts outside quotes.

    Each line is read once: quoted parts are taken out (a doubled quote stays inside), the counts of all delimiters go into running sums.
    """
    text = F.col(text) if isinstance(text, str) else text
    sample = F.slice(F.split(F.substring(text, 1, 8192), "\r?\n", -1), 1, 20)
    bare = F.transform(sample, lambda x: F.regexp_replace(x, '"(?:[^"]|"")*("|$)', ""))
    counts = F.transform(bare, lambda x: F.array(*((F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))).cast("double") for d in DELIMITERS)))
    sums = lambda n, s, q: F.struct(n.alias("n"), s.alias("s"), q.alias("q"))
    none = F.array_repeat(sums(F.lit(0.0), F.lit(0.0), F.lit(0.0)), len(DELIMITERS))
    added = F.aggregate(counts, none, lambda held, line: F.zip_with(held, line, lambda a, c: sums(a["n"] + F.when(c > 0, 1.0).otherwise(0.0), a["s"] + c, a["q"] + c * c)))
    score = lambda a: F.when(a["n"] > 0, F.round(a["s"] - 2 * (a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"])), 9)).otherwise(F.lit(-1.0))
    best = F.array_max(F.transform(added, lambda a, i: F.struct(score(a).alias("score"), (-i).alias("place"))))
    named = F.struct(best.alias("best"))
    chosen = F.element_at(F.transform(F.array(named), lambda x: F.when(x["best"]["score"] > -1, F.element_at(F.array(*map(F.lit, DELIMITERS)), 1 - x["best"]["place"])).otherwise(F.lit(","))), 1)
    return chosen


def delimited_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of parsed files without their all-blank rows, renumbered, down to the first ROW_CAP rows."""
    live = cells.groupBy(*keys, "row").agg(F.max(~md.is_blank("value")).alias("live")).where("live")
    live = live.withColumn("new", F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1).where(F.col("new") < ROW_CAP)
    return cells.join(live.select(*keys, "row", "new"), [*keys, "row"]).select(*keys, F.col("new").alias("row"), "col", "value")


# ---------------------------------------------------------------- JSON records


def record_cells(lines: DataFrame, keys: list[str], json_col: str = "json", order: str = "row") -> DataFrame:
    """Cells of flat JSON objects, a line each: columns in first-seen order. Lines that don't parse or aren't flat are dropped, and so are tables of over RECORD_COLUMNS columns."""
    parsed = lines.select(*keys, F.col(order).alias("row"), F.col(json_col).alias("__json"), F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT<%' and schema_of_variant(v) not like '%ARRAY<%' and substring(schema_of_variant(v), 8) not like '%OBJECT<%'")
    names = parsed.select(*keys, "row", "__json", F.posexplode(F.json_object_keys("__json")).alias("at", "name"))
    pairs = names.select(*keys, "row", "at", "name", F.expr("get_json_object(__json, concat('$[\\'', name, '\\']'))").alias("value"))
    columns = pairs.groupBy(*keys, "name").agg(F.min(F.struct("row", "at")).alias("seen"))
    columns = columns.withColumn("col", F.row_number().over(Window.partitionBy(*keys).orderBy("seen")) - 1).withColumn("k", F.count("*").over(Window.partitionBy(*keys))).where(F.col("k") <= RECORD_COLUMNS)
    head = columns.select(*keys, F.lit(-1).cast("long").alias("row"), "col", F.col("name").alias("value"))
    body = pairs.join(columns.select(*keys, "name", "col"), [*keys, "name"]).select(*keys, F.col("row").cast("long").alias("row"), "col", F.coalesce("value", F.lit("")).alias("value"))
    return head.unionByName(body)
