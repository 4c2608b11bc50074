"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are trigrams of character classes (what kind of letter, mark or space follows what), hashed byte trigrams and
a few structural counts (repeated neighbours, repeated words and lines). Labelled examples, at most PER_CLASS of each
label in an order given by a hash, fit the term weights and a truncated SVD of their matrix on the driver; their vectors
of RANK numbers are broadcast (below 4 MB whatever the corpus). Every document is folded in, its cosines with
all examples are computed exactly in blocks, and the K nearest vote with their similarity as weight. As each label is
sampled apart, votes are weighted by the label's share among all training rows.

Nulls and empty texts have no terms and get the share of label 1 among the training rows, as does every text if there is no
example. Repeated rows score alike; labels given twice for a doc_id count once (the lowest). Of examples with the same cosine at the edge of
the K nearest those with the smaller doc_id vote. Very long texts are read whole, in blocks. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import WORD_BYTES, crc_text, prepare, table

#: Labelled examples of each label that the classifier is fitted on, at most.
PER_CLASS = 1500
RANK, K, POWER = 48, 15, 4
CUT = 0.3
_CLASSES, _HASHED, _EXTRA = 14, 1024, 6
WIDTH = _CLASSES**3 + _HASHED + _EXTRA
_BLOCK = 1 << 20


def _class_table() -> np.ndarray:
    t = np.full(256, 12, np.int64)  # other ASCII
    t[128:] = 0  # parts of letters beyond ASCII, mostly
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!?", "#*$%&", "|", "<>{}[]=/\\", "'\"()-")):
        t[[ord(c) for c in chars]] = i
    t[:9] = 13
    return t


_TABLE = _class_table()


def terms(text: str | None) -> np.ndarray:
    """Counts of the WIDTH terms of a text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    n3 = _CLASSES**3
    for a in range(0, max(1, len(data) - 2), _BLOCK):
        piece = data[a : a + _BLOCK + 2]
        if len(piece) < 3:
            break
        c = _TABLE[piece]
        out[:n3] += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=n3)
        b = piece.astype(np.uint32)
        out[n3 : n3 + _HASHED] += np.bincount(((b[:-2] * 7919 + b[1:-1] * 104729 + b[2:] * 1299709) >> 4) % _HASHED, minlength=_HASHED)
    words = WORD_BYTES.findall(raw)
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words))
    out[n3 + _HASHED :] = (20 * same, len(words) - distinct, 5 * (len(lines) - len(set(lines))), len(words), sum(map(bytes.isupper, words)) * 4, distinct)
    return out


def matrix(texts, weights: np.ndarray | None = None) -> np.ndarray:
    x = np.log1p(np.stack([terms(t) for t in texts])) if len(texts) else np.zeros((0, WIDTH), np.float32)
    return x if weights is None else unit(x * weights)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def training(docs: DataFrame, labels: DataFrame, column: str, modulus: int, is_held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """text, label of at most per_class examples of each label, and how many training rows each label has."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(crc_text(F.col("doc_id")), F.lit(modulus)) != is_held_out)).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    shares = {int(r[0]): int(r[1]) for r in rows.groupBy("label").count().collect()}
    chosen = None
    for y in sorted(shares):
        part = rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    if chosen is None:
        chosen = rows.where("1 = 0")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), shares


class Model:
    """Term weights, the fold-in matrix, the examples' vectors, their labels and their votes' weights."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, shares: dict[int, int], rank: int = RANK, seed: int = 7):
        total = sum(shares.values())
        self.prior = shares.get(1, 0) / total if total else 0.5
        n = len(x)
        self.weights = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.2)
        rows = unit(x * self.weights)
        rank = min(rank, max(1, n))
        # Truncated SVD by subspace iteration.
        basis = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        for _ in range(5):
            basis, _ = np.linalg.qr(rows.T @ (rows @ basis)) if n else (basis, None)
        _, _, right = np.linalg.svd(rows @ basis, full_matrices=False) if n else (None, None, np.eye(basis.shape[1], dtype=np.float32))
        self.fold = (basis @ right.T)[:, :rank].astype(np.float32)
        self.examples = unit(rows @ self.fold)
        self.labels = labels.astype(np.float32)
        seen = np.array([max(1, (labels == y).sum()) for y in (0, 1)], np.float64)
        share = np.array([shares.get(y, 0) / max(1, total) for y in (0, 1)])
        self.votes = (share / seen)[labels.astype(int)].astype(np.float32) * n if n else np.zeros(0, np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of matrix(texts, weights)."""
        out = np.full(len(x), self.prior)
        has = np.flatnonzero((x != 0).any(axis=1))
        if not len(has) or not len(self.labels):
            return out
        cos = unit(x[has] @ self.fold) @ self.examples.T
        k = min(K, cos.shape[1])
        edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
        over, tie = cos > edge, cos == edge
        near = over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(axis=1, keepdims=True)))
        w = np.where(near, np.maximum(cos, 0) ** POWER * self.votes, 0)
        size = w.sum(axis=1)
        out[has] = np.where(size > 0, np.clip(w @ self.labels / np.where(size > 0, size, 1), 0, 1), self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, is_held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    prepare(docs.sparkSession)
    examples, shares = training(docs, labels, column, modulus, is_held_out, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [terms(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = examples.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label int, x binary").collect()
    found = sorted(((r[0], r[1], bytes(r[2])) for r in rows), key=lambda r: r[0])  # at most 2 * per_class vectors of WIDTH numbers
    x = np.log1p(np.frombuffer(b"".join(r[2] for r in found), np.float32).reshape(-1, WIDTH))
    return Model(x, np.array([r[1] for r in found], int), shares)


def score(docs: DataFrame, model: Model, modulus: int = 5, is_held_out: int = 0, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.scores(matrix([t.as_py() for t in batch.column(1).slice(a, 256)], m.weights)) for a in range(0, batch.num_rows, 256)]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(F.pmod(crc_text(F.col("doc_id")), F.lit(modulus)) == is_held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
