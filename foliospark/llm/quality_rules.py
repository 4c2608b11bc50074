"""Quality rules whose cutoffs follow the data: mergeable quantile sketches per language and source.

Each text is measured once (words, symbols, repeated lines and words, capitals). For every (lang, source) and measure the
values go into a logarithmic-bucket quantile sketch: a bucket's bounds differ by a fixed ratio, so a quantile is known
within that ratio, and sketches merge by adding counts, in any order and with the same result. The sketch is a table with
a row for each filled bucket; its size doesn't grow with the documents. Cutoffs are fences around the quartiles, drawn towards
the language's, and these towards those of all: a fence of n rows counts n / (n + PRIOR_ROWS), at every n. A join brings them to the documents.

Nulls and empty texts have no words, so they fail the base rule. A null lang or source is a group of its own. Repeated
rows are measured and judged alike, as are ties: a value on a fence passes. Very long texts are measured whole. An empty table gives an
empty result. In `filter_documents` extra columns pass by, whatever their names; `judge` doesn't read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm._common import WORD, WORD_BYTES, WordHashes, materialize, prepare, shingle_hashes, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")
SYMBOLS = "#*$%&|<>"
_SEPARATORS = " \t\n\x0b\x0c\r"
_words = WordHashes()

#: Measures: name, numerator, denominator, least spread that counts as spread, whether low values are odd too.
MEASURES = (
    ("symbols", "n_symbols", "word_chars", 0.01, False),
    ("marks", "n_marks", "word_chars", 0.02, False),
    ("capitals", "n_capitals", "n_words", 0.06, False),
    ("dup_lines", "n_dup_lines", "n_lines", 0.1, False),
    ("repeats", "n_repeat_words", "n_words", 0.06, False),
    ("word_length", "word_chars", "n_words", 0.6, True),
)
GAMMA = 1.02
FENCE = 3.0
#: Rows that a parent's fence counts for beside the rows of its own.
PRIOR_ROWS = 20.0
#: Group rows up to which the table of cutoffs (about 200 bytes a row) is broadcast.
BROADCAST_ROWS = 100_000


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    found = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass"))
    n = len(found)
    if n == 0:
        return (0,) * len(COUNTS)
    chars = len(text) - sum(map(text.count, _SEPARATORS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = 0
    if n > 8:
        h = shingle_hashes(np.fromiter(map(_words.__getitem__, found), np.uint64, n), 8)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 8, -1)
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    capitals = sum(map(bytes.isupper, found))  # words of capitals, by their ASCII letters
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), text.count("!"), capitals


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns in keep and COUNTS (long) for each row."""
    prepare(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(x.as_py()) for x in batch.column(len(keep))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(rows[:, i], pa.int64()) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{c} long" for c in COUNTS)]))


def _value(counts, measure_: tuple) -> Column:
    return F.try_divide(counts(measure_[1]).cast("double"), counts(measure_[2]).cast("double"))


def base_failed(counts=F.col) -> Column:
    return (counts("n_words") < 20) | (100 * counts("n_repeat_words") > 30 * counts("n_words"))


def cutoffs(rows: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """lang, source and for each measure low_<name>, high_<name>, from the rows that pass the base rule."""
    lang, source = group
    bucket = lambda v: F.when(v <= 1e-6, F.lit(-100_000)).otherwise(F.ceil(F.log(v) / F.lit(float(np.log(GAMMA)))).cast("int"))
    sketch = (
        rows.where(~base_failed())
        .select(lang, source, F.explode(F.array(*(F.struct(F.lit(i).alias("m"), bucket(_value(F.col, m)).alias("b")) for i, m in enumerate(MEASURES)))).alias("x"))
        .groupBy(lang, source, "x.m", "x.b")
        .agg(F.count("*").alias("n"))
    )
    sketch = materialize(sketch, "sketch")
    levels = sketch.select(F.lit(2).alias("level"), lang, source, "m", "b", "n")
    levels = levels.unionByName(sketch.select(F.lit(1).alias("level"), lang, F.lit(None).cast(sketch.schema[source].dataType).alias(source), "m", "b", "n"))
    levels = levels.unionByName(sketch.select(F.lit(0).alias("level"), F.lit(None).cast(sketch.schema[lang].dataType).alias(lang), F.lit(None).cast(sketch.schema[source].dataType).alias(source), "m", "b", "n"))
    levels = levels.groupBy("level", lang, source, "m", "b").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("level", lang, source, "m")
    ranked = levels.withColumn("below", F.sum("n").over(of.orderBy("b"))).withColumn("total", F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("b")))
    quartiles = ranked.groupBy("level", lang, source, "m").agg(at(0.25).alias("b1"), at(0.75).alias("b3"), F.first("total").alias("total"))
    worth = lambda b: F.when(F.col(b) == -100_000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col(b).cast("double")) * (2 / (1 + GAMMA)))
    least = F.element_at(F.array(*(F.lit(m[3]) for m in MEASURES)), F.col("m") + 1)
    spread = F.greatest(F.col("q3") - F.col("q1"), least)
    fences = quartiles.withColumn("q1", worth("b1")).withColumn("q3", worth("b3")).withColumns({"low": F.col("q1") - FENCE * spread, "high": F.col("q3") + FENCE * spread})
    pick = lambda i, c: F.max(F.when(F.col("m") == i, F.col(c)))
    wide = fences.groupBy("level", lang, source).agg(F.max("total").alias("total"), F.struct(*(pick(i, c).alias(f"{c}_{m[0]}") for i, m in enumerate(MEASURES) for c in ("low", "high"))).alias("f"))
    wide = materialize(wide, "fences")
    own, tongue, everything = (wide.where(F.col("level") == k) for k in (2, 1, 0))
    tongue = tongue.select(F.col(lang).alias("l1"), F.col("total").alias("t1"), F.col("f").alias("f1"))
    everything = everything.select(F.lit(1).alias("one"), F.col("f").alias("f0"))
    out = own.withColumn("one", F.lit(1)).join(tongue, F.col(lang).eqNullSafe(F.col("l1")), "left").join(everything, "one", "left")

    def drawn(total: str, fence: Column, parent: Column) -> Column:
        share = F.col(total) / (F.col(total) + PRIOR_ROWS)
        return share * fence + (1 - share) * parent

    names = [f"{c}_{m[0]}" for m in MEASURES for c in ("low", "high")]
    f = [drawn("total", F.col(f"f.{c}"), drawn("t1", F.col(f"f1.{c}"), F.col(f"f0.{c}"))).alias(c) for c in names]
    return materialize(out.select(lang, source, *f), "cutoffs")


def passes(counts=F.col, fence=F.col) -> Column:
    """Whether a row is within all fences; without fences (no row of its group passed the base rule) it isn't."""
    ok = F.lit(True)
    for m in MEASURES:
        v = _value(counts, m)
        ok = ok & (v <= fence(f"high_{m[0]}"))
        if m[4]:
            ok = ok & (v >= fence(f"low_{m[0]}"))
    return F.coalesce(ok & ~base_failed(counts), F.lit(False))


def _with_fences(rows: DataFrame, fences: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    renamed = fences.select(F.col("lang").alias("__fs_lang"), F.col("source").alias("__fs_source"), F.struct(*(c for c in fences.columns if c not in ("lang", "source"))).alias("__fs_fence"))
    if fences.count() <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    return rows.join(renamed, rows[group[0]].eqNullSafe(F.col("__fs_lang")) & rows[group[1]].eqNullSafe(F.col("__fs_source")), "left")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the other COUNTS for each row of docs."""
    rows = materialize(measured(docs), "measured")
    out = _with_fences(rows, cutoffs(rows))
    return out.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), passes(F.col, lambda c: F.col(f"__fs_fence.{c}")).alias("kept"), *COUNTS[5:])


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns. Each text is measured once: the rows are written with their counts and read again."""
    prepare(docs.sparkSession)
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

    @F.pandas_udf(kind)
    def counts(texts):
        import pandas as pd

        rows = np.array([measure(x) for x in texts], np.int64).reshape(-1, len(COUNTS))
        return pd.DataFrame(dict(zip(COUNTS, rows.T, strict=True)))

    rows = materialize(docs.withColumn("__fs_counts", counts("text")), "measured")
    found = _with_fences(rows, cutoffs(rows.select("lang", "source", "__fs_counts.*")))
    return found.where(passes(lambda c: F.col(f"__fs_counts.{c}"), lambda c: F.col(f"__fs_fence.{c}"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
