"""Structure of positioned text: running lines, body size, heading sizes, gaps, runs and list numbers.

All are aggregates and windows keyed by document, so they share one exchange by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE, SHARE, LEAST_PAGES = 2, 0.6, 3


def fingerprint(y: Column, text: Column) -> Column:
    """Height in steps of six and the start of the text with digits masked: equal for a page's running lines."""
    return F.concat(F.floor(y / 6 + 0.5).cast("long").cast("string"), F.lit("|"), F.substring(F.regexp_replace(F.lower(text), "[0-9]+", "#"), 1, 60))


def running_lines(lines: DataFrame, doc: str = "doc", page: str = "page", n: str = "n", share: float = SHARE) -> DataFrame:
    """The edge lines (doc, page, n, print) of documents of at least three pages whose fingerprint (column print) stands on at least three pages and that share of all."""
    up, down = (Window.partitionBy(doc, page).orderBy(o) for o in (F.col(n), F.desc(n)))
    edges = lines.withColumns({"__a": F.row_number().over(up), "__b": F.row_number().over(down)}).where((F.col("__a") <= EDGE) | (F.col("__b") <= EDGE))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("__pages")).where(F.col("__pages") >= LEAST_PAGES)
    seen = edges.select(doc, page, "print").distinct().groupBy(doc, "print").agg(F.count("*").alias("__n"))
    often = seen.join(pages, doc).where(F.col("__n") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("__pages") * share)))
    return edges.join(often.select(doc, "print"), [doc, "print"], "left_semi").select(doc, page, n, "print")


def without_running_lines(lines: DataFrame, doc: str = "doc", page: str = "page", n: str = "n", share: float = SHARE) -> DataFrame:
    return lines.join(running_lines(lines, doc, page, n, share), [doc, page, n], "left_anti")


def half_steps(size) -> Column:
    return F.floor(F.col(size) * 2 + 0.5) / 2


def body_sizes(lines: DataFrame, doc: str, size: str, weight: str, order: str) -> DataFrame:
    """doc, body: the size (to half a point) that most text has; the first seen wins a tie."""
    by = lines.groupBy(doc, half_steps(size).alias("__s")).agg(F.sum(weight).alias("__w"), F.min(order).alias("__o"))
    return by.groupBy(doc).agg(F.max_by("__s", F.struct("__w", -F.col("__o"), -F.col("__s"))).alias("body"))


def heading_sizes(lines: DataFrame, bodies: DataFrame, doc: str, size: str, most: int = 6) -> DataFrame:
    """doc, size, level: the largest sizes over 1.08 times the body's, numbered from 1."""
    sizes = lines.select(doc, half_steps(size).alias("size")).distinct().join(bodies, doc).where(F.col("size") > F.col("body") * 1.08)
    return sizes.withColumn("level", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("size")))).where(F.col("level") <= most).select(doc, "size", "level")


def median_gaps(lines: DataFrame, keys: list[str], y: str, order: str, body: Column) -> DataFrame:
    """keys, gap: the median of the positive distances to the line before; 1.2 times the body size without any."""
    gap = F.lag(y).over(Window.partitionBy(*keys).orderBy(order)) - F.col(y)
    of = lines.withColumn("__g", gap)
    return of.groupBy(*keys).agg(F.coalesce(F.percentile(F.when(F.col("__g") > 0, F.col("__g")), F.lit(0.5)), F.first(body) * 1.2).alias("gap"))


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as one: a hyphen before a small letter is taken back, other breaks become a space."""
    start = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        hyphen = acc.rlike("[-­]$") & x.rlike("^\\p{Ll}")
        return F.when(acc == "", x).when(hyphen, F.concat(F.regexp_replace(acc, "[-­]$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x))

    return F.aggregate(lines, start, step)


def merge_runs(runs: DataFrame, keys: list[str], order: str, fmt: list[str], text: str = "text") -> DataFrame:
    """Neighbouring runs of one format as one: keys, run (from 1), fmt..., text."""
    w = Window.partitionBy(*keys).orderBy(order)
    now = F.struct(*fmt)
    marked = runs.withColumn("__f", now).withColumn("run", F.sum(F.when(F.coalesce(F.lag("__f").over(w).eqNullSafe(F.col("__f")), F.lit(False)), 0).otherwise(1)).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "")
    return marked.groupBy(*keys, "run", *fmt).agg(joined.alias(text))


def list_numbers(items: DataFrame, keys: list[str], order: str, level: str, is_item: str) -> DataFrame:
    """items with number (0 for what is no item): an item's place among those of its level since the last item of a smaller level or anything that is no item."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = items
    live = F.col(is_item)
    # An island of a level ends where a shallower item or no item stands; levels are few, so one running maximum each.
    levels = 9
    for k in range(levels):
        out = out.withColumn(f"__end{k}", F.max(F.when(~live | (F.col(level) < k), F.col(order))).over(w))
    island = F.element_at(F.array(*(F.coalesce(F.col(f"__end{k}").cast("long"), F.lit(-1).cast("long")) for k in range(levels))), F.least(F.col(level), F.lit(levels - 1)).cast("int") + 1)
    out = out.withColumn("__island", island)
    count = F.row_number().over(Window.partitionBy(*keys, is_item, level, "__island").orderBy(order))
    return out.withColumn("number", F.when(live, count).otherwise(0)).drop("__island", *(f"__end{k}" for k in range(levels)))
