"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

1. Rows fall into logical partitions by a hash of their content, so a lost task is redone with the same result. The rows
   of each are counted (a pre-aggregated sum; a number per partition, bounded by PARTITIONS, comes to the driver).
   Rows that are equal in all columns get numbers there, which go into the hashes that follow: copies are dealt out like
   any other rows. A content with over ROWS_EACH rows is told by its count, and its rows are made again, in parts of ROWS_EACH,
   each row with its number in its hash, so that they fall into all partitions.
2. The matrix of how many rows go from each partition to each shard is drawn on the driver from the multivariate
   hypergeometric distribution: just as a uniform random permutation of all rows would fill shards of these sizes.
3. Rows are permuted inside their partition (ordered by a hash); the first C[p][0] go to shard 0, and so on.
4. Rows are exchanged and permuted again: they're dealt by (shard, slice of a second hash) and ordered by that hash, and a
   slot is the sum of the earlier slices' counts plus the place in the slice. No task holds a whole shard.

Law: `rows`; shard sizes are at most one apart. Only DataFrame functions touch the rows. Nulls: a null text has size 1 and
crc32 0. Which of some equal rows takes which of their slots doesn't show. Ties of two hashes of 64 bits go by the other one. An empty table gives an
empty result; very long texts pass whole. Columns of docs named shard or slot stay, and the result's are then called assigned_shard and assigned_slot.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm._common import prepare, table

SHARDS = 16
SEED = 29
#: At most and at least so many logical partitions; between, one for so many rows.
PARTITIONS, FEWEST, ROWS_EACH = 16_384, 256, 200_000


def draw_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows from each partition to each shard; the row sums are counts, the column sums at most one apart."""
    total = int(counts.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    random = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        rest = int(n)
        pool = int(left.sum())
        for s in range(shards):
            pool -= int(left[s])
            got = rest if pool == 0 else _hypergeometric(random, int(left[s]), pool, rest)
            out[i, s] = got
            rest -= got
        left -= out[i]
    return out


def _hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(random.hypergeometric(good, bad, draws))
    # Beyond the generator's range: invert the distribution over all counts within 12 deviations of its mode.
    total = good + bad
    if draws > total // 2:  # what stays behind is hypergeometric too
        return good - _hypergeometric(random, good, bad, total - draws)
    share = good / total
    mode = int((draws + 1) * (good + 1) / (total + 2))
    spread = 20 + int(12 * math.sqrt(draws * share * (1 - share) * (1 - draws / total)))
    k = np.arange(max(0, draws - bad, mode - spread), min(draws, good, mode + spread) + 1, dtype=np.float64)
    ratio = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    weight = np.append(0.0, np.cumsum(ratio))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(weight, random.random() * weight[-1])])


def _hash(docs: DataFrame, seed: int) -> Column:
    """A 64-bit hash of a row's columns (without maps, which have none)."""
    return F.xxhash64(F.lit(seed), *(F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))))


def _lookup(docs: DataFrame, rows: list[dict], fields: str) -> DataFrame:
    """A bounded table from the driver, as a literal."""
    return docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")).alias("x")).select("x.*")


def _made_again(hashed: DataFrame, own: list[Column], often: list, rows_each: int) -> DataFrame:
    """hashed with the rows of the contents in often (their two hashes and count) replaced by as many of the same content, with hashes of their own."""
    known = _lookup(hashed, [{"a": r[0], "b": r[1], "k": r[2]} for r in often], "a:bigint,b:bigint,k:bigint")
    known = F.broadcast(known.select(F.col("a").alias("__fs_1"), F.col("b").alias("__fs_2"), F.col("k").alias("__fs_k")))
    one = hashed.join(known, ["__fs_1", "__fs_2"]).groupBy("__fs_1", "__fs_2").agg(F.first("__fs_k").alias("__fs_k"), F.first(F.struct(*own)).alias("__fs_row"))
    chunks = one.withColumn("__fs_c", F.explode(F.expr(f"sequence(0L, (__fs_k - 1) div {rows_each})"))).repartition("__fs_1", "__fs_c")
    rows = chunks.withColumn("__fs_i", F.explode(F.expr(f"sequence(__fs_c * {rows_each} + 1, least(__fs_k, (__fs_c + 1) * {rows_each}))")))
    rows = rows.select("__fs_row.*", F.xxhash64("__fs_1", "__fs_i").alias("__fs_1"), F.xxhash64("__fs_2", "__fs_i").alias("__fs_2"))
    return hashed.join(known.drop("__fs_k"), ["__fs_1", "__fs_2"], "left_anti").select(*own, "__fs_1", "__fs_2").unionByName(rows)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_each: int = ROWS_EACH) -> DataFrame:
    """docs' columns with shard (int) and slot (long, from 0 without gaps in each shard)."""
    prepare(docs.sparkSession)
    n = docs.count()
    parts = min(PARTITIONS, max(FEWEST, 1 << max(0, (n // rows_each)).bit_length()))
    own = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumns({"__fs_1": _hash(docs, seed), "__fs_2": _hash(docs, seed + 1)})
    in_part = lambda rows: rows.withColumn("__fs_p", F.pmod("__fs_1", F.lit(parts)).cast("int"))

    def counted(rows: DataFrame) -> np.ndarray:
        out = np.zeros(parts, np.int64)
        for row in rows.groupBy("__fs_p").count().collect():  # at most `parts` numbers
            out[row[0]] = row[1]
        return out

    keyed = in_part(hashed)
    counts = counted(keyed)
    full = np.flatnonzero(counts > rows_each + 4 * n / parts).tolist()
    if full:
        often = keyed.where(F.col("__fs_p").isin(full)).groupBy("__fs_1", "__fs_2").count().where(F.col("count") > rows_each).collect()  # at most n / rows_each rows
        if often:
            keyed = in_part(_made_again(hashed, own, often, rows_each))
            counts = counted(keyed)
    # Numbers for equal rows, and hashes that are a row's own, inside the partition.
    keyed = keyed.repartition("__fs_p").withColumn("__fs_j", F.row_number().over(Window.partitionBy("__fs_p", "__fs_1", "__fs_2").orderBy("__fs_2")))
    keyed = keyed.withColumns({"__fs_1": F.xxhash64(F.lit(seed + 2), "__fs_1", "__fs_j"), "__fs_2": F.xxhash64(F.lit(seed + 3), "__fs_2", "__fs_j")}).drop("__fs_j")
    upto = np.cumsum(draw_matrix(counts, shards, seed), axis=1)
    matrix = _lookup(docs, [{"p": i, "upto": x.tolist()} for i, x in enumerate(upto)], "p:int,upto:array<bigint>").select(F.col("p").alias("__fs_p"), F.col("upto").alias("__fs_upto"))
    rank = F.row_number().over(Window.partitionBy("__fs_p").orderBy("__fs_1"))
    slices = max(1, parts // shards)
    placed = (
        keyed.withColumn("__fs_rank", rank)
        .join(F.broadcast(matrix), "__fs_p")
        .withColumn("__fs_shard", F.size(F.filter("__fs_upto", lambda x: x < F.col("__fs_rank"))).cast("int"))
        .withColumn("__fs_slice", F.pmod(F.shiftrightunsigned("__fs_2", 16), F.lit(slices)).cast("int"))
    )
    held = np.zeros((shards, slices), np.int64)
    for row in placed.groupBy("__fs_shard", "__fs_slice").count().collect():  # at most `parts` numbers
        held[row[0], row[1]] = row[2]
    before = np.cumsum(held, axis=1) - held
    offsets = _lookup(docs, [{"s": s, "k": k, "o": int(before[s, k])} for s in range(shards) for k in range(slices)], "s:int,k:int,o:bigint").select(F.col("s").alias("__fs_shard"), F.col("k").alias("__fs_slice"), F.col("o").alias("__fs_offset"))
    place = F.row_number().over(Window.partitionBy("__fs_shard", "__fs_slice").orderBy("__fs_2", "__fs_1"))
    out = placed.drop("__fs_upto", "__fs_rank", "__fs_p").withColumn("__fs_place", place).join(F.broadcast(offsets), ["__fs_shard", "__fs_slice"])
    name = lambda c: f"assigned_{c}" if c in docs.columns else c
    return out.select(*own, F.col("__fs_shard").alias(name("shard")), (F.col("__fs_offset") + F.col("__fs_place") - 1).cast("long").alias(name("slot")))


def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt; size and crc32 are read from what arrives."""
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_uniform_shards": op4_uniform_shards}
