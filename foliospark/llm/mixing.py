"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and n of the N rows gets the mean repetition w * N / n. A row's count inverts the
Poisson distribution of that mean at a uniform number hashed from (seed, doc_id): no state, no order, the same on every
run. Means over CHUNK are split into equal parts with a number each, whose counts add up (a sum of Poisson counts is
one), so that the inversion never underflows. Rows are exploded by their count and shuffled by a hashed key: dealt out
and sorted by it, so no source, key or input order stays together. Counting rows per source is a pre-aggregated sum; the
table of sources is joined, broadcast while small. A hot source is never gathered in one task.

Nulls: a null source is a source of its own; a null doc_id hashes as the word null. Rows with one doc_id draw one count, also repeated ones; there are no ties to break.
A source without a target weight, or with weight 0, gets no rows. An empty table gives an empty result; very long and empty texts pass whole. Columns of docs
with the names of the result's (copy, n_copies, shuffle_key) stay, and the result's then begin with __fs_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm._common import materialize, prepare, table

CHUNK = 16.0
#: Terms of the inverted distribution; beyond them the rest of a mean of at most CHUNK is below 1e-25.
TERMS = 100
SEED = 17
#: Without given weights a source's target share is its own share to this power, renormalised.
TEMPER = 0.5
#: Sources up to which their table (about 1 KB a row) is broadcast.
BROADCAST_ROWS = 20_000


def uniform(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, as a number from 0 up to but not 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER) -> DataFrame:
    """source, rate (mean repetitions), parts and cdf of the Poisson distribution of rate / parts."""
    n = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # a row for each source
    if weights is None:
        share = F.pow(F.col("n"), F.lit(temper))
    else:
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.col("source")), F.lit(0.0))
    rate = F.col("share") / F.sum("share").over(everything) * F.sum("n").over(everything) / F.col("n")
    out = n.withColumn("share", share).withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int")))
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return out.select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda x: x["cdf"]).alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """docs' columns, then copy (from 1), n_copies and shuffle_key, in shuffled order."""
    prepare(docs.sparkSession)
    table_ = materialize(rates(docs, weights, temper), "rates")
    small = table_.select(F.col("source").alias("__fs_source"), F.struct("parts", "cdf").alias("__fs_rate"))
    if table_.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__fs_rate.parts")),
        F.lit(0),
        lambda acc, i: acc + F.size(F.filter(F.col("__fs_rate.cdf"), lambda c: c <= uniform(F.lit(str(seed)), key, i.cast("string")))),
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(small, docs["source"].eqNullSafe(F.col("__fs_source"))).select(*own, drawn.alias("__fs_n")).where("__fs_n > 0")
    out = out.select(*own, F.col("__fs_n"), F.explode(F.sequence(F.lit(1), F.col("__fs_n"))).alias("__fs_copy"))
    out = out.withColumn("__fs_key", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), key, F.col("__fs_copy").cast("string"))))
    if shuffle:
        out = out.repartition("__fs_key").sortWithinPartitions("__fs_key")
    extra = {"__fs_copy": "copy", "__fs_n": "n_copies", "__fs_key": "shuffle_key"}
    return out.select(*own, *(F.col(a).alias(b if b not in docs.columns else a) for a, b in extra.items()))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are repeated and shuffled; their texts are read from what arrives, as bytes and a digest."""
    out = replicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


ORACLES = {
    "op5_source_mixing": f"""
WITH s AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
r AS (SELECT source, coalesce(sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n, 0.0) AS rate FROM s),
p AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {CHUNK})) AS INTEGER) AS parts FROM r),
t AS (SELECT source, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS pk FROM p, range(0, {TERMS} + 1) x(k)),
c AS (SELECT source, parts, k, sum(pk) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
l AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source, parts),
u AS (SELECT d.doc_id, d.source, d.text, l.cdf, CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source, unnest(range(1, l.parts + 1)) x(i)),
n AS (SELECT doc_id, source, text, CAST(sum(len(list_filter(cdf, lambda z: z <= u))) AS INTEGER) AS n_copies FROM u GROUP BY doc_id, source, text)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, n_copies, md5('{SEED}s|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(copy AS VARCHAR)) AS shuffle_key,
CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS text_md5
FROM n, unnest(range(1, n_copies + 1)) y(copy)"""
}
QUERIES = {"op5_source_mixing": op5_source_mixing}
