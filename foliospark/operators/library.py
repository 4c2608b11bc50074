"""The document library as tables: listing, versions, names that differ, contents, archives' file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import markdown as md


def listing(docs: DataFrame) -> DataFrame:
    """id, name, updated, words of rows (id, name, markdown, updated) that have all their parts, newest first."""
    whole = docs.where("markdown is not null and name is not null and updated is not null")
    return whole.select("id", "name", "updated", md.library_words("markdown").alias("words")).orderBy(F.desc("updated"), "id")


def from_json(values: DataFrame, column: str = "value") -> DataFrame:
    """id, name, markdown, updated from stored JSON values; corrupt or partial ones are left out."""
    parsed = values.select("id", F.from_json(F.col(column), "name string, markdown string, updated long").alias("d"))
    return parsed.select("id", "d.*").where("markdown is not null and name is not null and updated is not null")


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs after changes (id, op: save, rename or delete, name, markdown, updated): the latest change of an id counts for each field."""
    rows = docs.select("id", F.lit("save").alias("op"), "name", "markdown", "updated").unionByName(changes.select("id", "op", "name", "markdown", "updated"))
    known = docs.select("id").unionByName(changes.where("op = 'save' and name is not null and markdown is not null").select("id")).distinct()
    latest = rows.groupBy("id").agg(F.max_by("op", "updated").alias("op"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("updated"))).alias("name"), F.max_by("markdown", F.when(F.col("markdown").isNotNull(), F.col("updated"))).alias("markdown"), F.max("updated").alias("updated"))
    left = latest.join(known, "id", "left_semi").where("op <> 'delete'").drop("op")
    # A name that a rename or a new document takes from another one is numbered: who had it first keeps it.
    named = unique_names(left.withColumns({"name": md.library_name("name"), "__o": F.struct("updated", "id")}), "name", "__o")
    return named.select("id", F.col("unique_name").alias("name"), "markdown", "updated")


def read(docs: DataFrame, id_: str) -> DataFrame:
    """The whole document of an id: no row where it is unknown or lacks a part."""
    return docs.where((F.col("id") == id_) & F.col("name").isNotNull() & F.col("markdown").isNotNull() & F.col("updated").isNotNull()).select("id", "name", "markdown", "updated")


def created(names: DataFrame) -> DataFrame:
    """Changes that create documents (id, name or null, updated): each begins with its title as a heading."""
    name = md.library_name(F.coalesce("name", F.lit("Untitled")))
    return names.select("id", F.lit("save").alias("op"), name.alias("name"), F.concat(F.lit("# "), _stem(name), F.lit("\n\n")).alias("markdown"), "updated")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.md$", "")


def unique_names(docs: DataFrame, name: str, order: str, spaced: bool = True) -> DataFrame:
    """docs with unique_name. In order, a name keeps its form if free; else its stem gets the first free number from 2.

    spaced: 'stem 2.md', compared without case (the library); else 'stem-2.md', compared with case (archives). Rows whose
    names could collide, themselves or with a numbered form, share a family and are settled by window functions: the k-th
    repetition takes the k-th number from 2 that no given name has.
    """
    gap = " " if spaced else "-"
    fold = F.lower if spaced else (lambda c: c)
    given = F.col(name)
    tagged = docs.withColumn("__key", fold(given)).withColumn("__stem", fold(_stem(given)))
    k = F.row_number().over(Window.partitionBy("__key").orderBy(order))
    tagged = tagged.withColumn("__k", k)
    number = F.regexp_extract("__stem", rf"{gap}([0-9]+)$", 1)
    taken = tagged.where((F.col("__k") == 1) & (number != "") & F.col("__key").endswith(".md")).select(F.regexp_replace("__stem", rf"{gap}[0-9]+$", "").alias("__stem"), number.try_cast("bigint").alias("n"))
    taken = taken.groupBy("__stem").agg(F.collect_set("n").alias("__taken"))
    out = tagged.join(taken, "__stem", "left")
    want = F.col("__k") - 1
    free = F.filter(F.sequence(F.lit(2), F.lit(2) + want + F.coalesce(F.size("__taken"), F.lit(0))), lambda n: ~F.coalesce(F.array_contains("__taken", n), F.lit(False)))
    numbered = F.concat(_stem(given), F.lit(gap), F.element_at(free, F.greatest(want, F.lit(1)).cast("int")).cast("string"), F.lit(".md"))
    return out.withColumn("unique_name", F.when(F.col("__k") == 1, given).otherwise(numbered)).select(*docs.columns, "unique_name")


def contents(docs: DataFrame, key: str, markdown: str = "markdown") -> DataFrame:
    """key, n (from 1), level, title, anchor of headings of levels 1 to 3, of documents that have two at least."""
    body = F.regexp_replace(F.col(markdown), r"(?s)```.*?```", "")
    lines = docs.select(key, F.posexplode(F.split(body, "\n", -1)).alias("at", "line"))
    heads = lines.where(F.col("line").rlike(r"^#{1,3} +\S")).select(key, "at", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), md.trim(md.unescape(F.regexp_replace("line", "^#+ +", ""))).alias("title"))
    w = Window.partitionBy(key)
    heads = heads.withColumn("n", F.row_number().over(w.orderBy("at"))).withColumn("k", F.count("*").over(w)).where("k >= 2")
    return heads.select(key, "n", "level", "title", F.concat(F.lit("section-"), F.col("n").cast("string")).alias("anchor"))


def summary(results: DataFrame) -> DataFrame:
    """name and a line of format, words, images, size and time, with at most six warnings."""
    words, images = F.col("word_count"), F.col("image_count")
    parts = F.array_compact(F.array(F.col("format"), F.concat(F.format_number(words, 0), F.lit(" words")), F.when(images > 0, F.concat(images.cast("string"), F.when(images == 1, " image").otherwise(" images"))), md.format_bytes(F.octet_length("markdown")), F.concat(F.round("duration_ms").cast("long").cast("string"), F.lit(" ms"))))
    return results.select("name", F.array_join(parts, " · ").alias("summary"), F.slice("warnings", 1, 6).alias("warnings"))
