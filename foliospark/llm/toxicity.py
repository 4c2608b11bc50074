"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Terms are lower-cased words (runs of letters). The vocabulary is that of the labelled examples, whole (at most PER_CLASS
examples of each label, in an order given by a hash). A term's weight is its inverse document frequency over all documents times
EASE + c / (c + HALF), where c is its chi-square with the label over the examples: words that tell labels apart count up to
1 / EASE times as much, none is left out. Vectors are (1 + ln n) * weight over the vocabulary, of length 1.

The examples' vectors go into an inverted index cut into blocks of BLOCK examples, with each term's largest weight in each
block. Terms that over a DENSE-th of the examples have stand in a dense matrix instead, which a batch of documents is multiplied with.
For a document the blocks' upper bounds are added up from both; postings are read of the blocks with the largest ones,
then of further ones, until no block left can hold one of the K nearest: the neighbours are exact, and every text with a word
of an example has some. Votes are weighted by the squared cosine, and by the label's share among all training rows, as
each label is sampled apart. A logistic curve, fitted on the examples' own votes (each without itself and its copies), makes them calibrated scores.

A text without any term (null and empty ones too) has no neighbour, scores the share of label 1, and has null evidence; so has every text if
there is no example. Ties go to the smaller doc_id. Very long texts are read whole. Repeated rows score alike; labels given twice count once; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import crc_text, prepare, table
from foliospark.llm.quality_classifier import training

#: Labelled examples of each label that the index is fitted on, at most.
PER_CLASS = 1500
EASE, HALF = 0.1, 30.0
K, POWER, BLOCK, FIRST_BLOCKS, SMOOTH, CUT = 40, 2, 64, 8, 1e-3, 0.7
DENSE, BATCH = 16, 256
#: Cosine from which an example counts as a copy when the curve is fitted; terms whose counts make one row of a task.
COPY, PART = 0.999, 1 << 14
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORDS.findall(text.lower())) if text else Counter()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start[i], start[i] + 1, ... start[i] + size[i] - 1."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Examples (doc_id, label, term counts) as a block-max inverted index; weight by vocabulary term, how many training rows each label has."""

    def __init__(self, vocabulary: list[str], weight: np.ndarray, examples: list[tuple], shares: dict[int, int]):
        self.vocabulary, self.weight = vocabulary, np.asarray(weight, np.float64)
        total = sum(shares.values())
        self.prior = shares.get(1, 0) / total if total else 0.0
        rows = [(i, y, *v) for i, y, c in examples if len((v := self.vector(c))[0])]
        rows.sort(key=lambda r: (-r[1], r[0]))  # blocks of one label have sharper bounds
        self.ids = [r[0] for r in rows]
        self.rank = np.argsort(np.argsort(np.array(self.ids))) if rows else np.empty(0, np.int64)
        self.labels = np.array([r[1] for r in rows], np.float64)
        self.votes = np.array([shares.get(int(y), 0) / (self.labels == y).sum() for y in self.labels]) * len(rows) / max(1, total)
        self.n_blocks = -(-len(rows) // BLOCK)
        term = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.int64)
        at = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        value = np.concatenate([r[3] for r in rows]) if rows else np.empty(0)
        order = np.lexsort((at, term))
        term, at, value = term[order], at[order], value[order]
        often = np.bincount(term, minlength=len(vocabulary)) * DENSE > len(rows)
        self.dense_row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.n_blocks * BLOCK))
        in_dense = often[term]
        self.dense[self.dense_row[term[in_dense]], at[in_dense]] = value[in_dense]
        term, self.at, self.value = term[~in_dense], at[~in_dense], value[~in_dense]
        # A cell is what one term has in one block: its postings stand side by side.
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (self.at[1:] // BLOCK != self.at[:-1] // BLOCK))[: len(term)])
        self.cell_start, self.cell_size = first, np.diff(np.append(first, len(term)))
        self.cell_block = self.at[first] // BLOCK
        self.cell_most = np.maximum.reduceat(self.value, first) if len(first) else np.empty(0)
        self.cells = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))
        self.curve = (0.0, 1.0)
        self.curve = self._calibrated(rows)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and their weights, of length 1."""
        t = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[x] for x in t.tolist()])) * self.weight[t] if len(t) else np.empty(0)
        size = float(np.sqrt(w @ w))
        return (t, w / size) if size else (t[:0], w[:0])

    def bases(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the dense terms add to the cosines: a row for each vector, a column for each example."""
        q = np.zeros((len(vectors), len(self.dense)))
        for row, (t, w) in zip(q, vectors, strict=True):
            place = self.dense_row[t]
            row[place[place >= 0]] = w[place >= 0]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, base: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k examples with the largest positive cosine, exactly, as (cosine, example); ties by the smaller doc_id."""
        if not len(terms) or not self.n_blocks:
            return []
        base = self.bases([(terms, weights)])[0] if base is None else base
        sizes = self.cells[terms + 1] - self.cells[terms]
        cell = _ranges(self.cells[terms], sizes)
        asked, block = np.repeat(weights, sizes), self.cell_block[cell]
        bound = np.bincount(block, asked * self.cell_most[cell], self.n_blocks) + base.reshape(-1, BLOCK).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score = np.zeros(len(base))
        by_block, from_base = score.reshape(-1, BLOCK), base.reshape(-1, BLOCK)
        least, done, step = 0.0, 0, FIRST_BLOCKS
        while done < len(order) and bound[order[done]] >= least - 1e-12:  # no later block reaches further
            now = order[done : done + step]
            now = now[bound[now] >= least - 1e-12]
            chosen = np.zeros(self.n_blocks, bool)
            chosen[now] = True
            mine = np.flatnonzero(chosen[block])
            size = self.cell_size[cell[mine]]
            place = _ranges(self.cell_start[cell[mine]], size)
            by_block[now] = from_base[now]
            score += np.bincount(self.at[place], np.repeat(asked[mine], size) * self.value[place], len(score))
            done, step = done + step, 8 * step
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
        found = np.flatnonzero(score >= max(least - 1e-12, 1e-300))
        found = found[np.lexsort((self.rank[found], -np.round(score[found], 12)))][:k]
        return list(zip(score[found].tolist(), found.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1 among the neighbours, by squared cosine and by what each label's examples stand for."""
        s, e = np.array([x[0] for x in near]), np.array([x[1] for x in near])
        w = s**POWER * self.votes[e]
        return float((w @ self.labels[e] + SMOOTH * self.prior) / (w.sum() + SMOOTH))

    def _calibrated(self, rows: list[tuple]) -> tuple[float, float]:
        """Intercept and slope of the logistic curve over the logit of the vote, by Newton's method on the examples."""
        votes, labels, weight = [], [], []
        for place, (_, y, t, w) in enumerate(rows):
            near = [x for x in self.nearest(t, w, K + 10) if x[1] != place and x[0] < COPY][:K]
            if near:
                votes.append(self.vote(near))
                labels.append(y)
                weight.append(self.votes[place])
        y, w = np.array(labels, np.float64), np.array(weight)
        if not len(y) or y.min() == y.max():
            return self.curve
        x = np.stack([np.ones(len(y)), _logit(np.array(votes))], axis=1)
        beta = np.array([0.0, 1.0])
        for _ in range(30):  # with a weak pull towards the vote itself, which a few examples need
            p = 1 / (1 + np.exp(-x @ beta))
            slope = x.T @ (w * (y - p)) - 0.1 * (beta - [0.0, 1.0])
            bend = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            step = np.linalg.solve(bend, slope)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return (float(beta[0]), float(max(beta[1], 0.05)))

    def judge(self, counts: list[dict[int, int]]) -> Iterator[tuple[float, object, float | None, str | None]]:
        """For each document its score, the nearest example's doc_id, its cosine, and the terms that count most."""
        for a in range(0, len(counts), BATCH):
            vectors = [self.vector(c) for c in counts[a : a + BATCH]]
            for v, base in zip(vectors, self.bases(vectors), strict=True):
                yield self._judged(*v, self.nearest(*v, base=base))

    def _judged(self, terms: np.ndarray, weights: np.ndarray, near: list[tuple[float, int]]) -> tuple[float, object, float | None, str | None]:
        if not near:
            return self.prior, None, None, None
        score = float(1 / (1 + np.exp(-self.curve[0] - self.curve[1] * _logit(self.vote(near)))))
        told = np.lexsort((terms, -weights))[:3]
        return score, self.ids[near[0][1]], near[0][0], " ".join(self.vocabulary[t] for t in terms[told].tolist())


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and how many there are. Tasks send packed counts, PART terms a row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = {t: i for i, t in enumerate(sent.value)}, np.zeros(-(-size // PART) * PART, np.int64)
        for batch in batches:
            for text in batch.column(0):
                held[size - 1] += 1
                if t := text.as_py():
                    found = [number[w] for w in number.keys() & set(_WORDS.findall(t.lower()))]
                    held[found] += 1
        parts = [x for x in enumerate(held.reshape(-1, PART)) if x[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["part", "held"])

    def total(rows: pa.Table) -> pa.Table:
        held = np.zeros(PART, np.int64)
        for x in rows.column("held"):
            held += np.frombuffer(x.as_py(), np.int64)
        return pa.table([rows.column("part").slice(0, 1), pa.array([held.tobytes()], pa.binary())], names=["part", "held"])

    out = np.zeros(-(-size // PART) * PART, np.int64)
    for part, held in docs.select("text").mapInArrow(run, "part int, held binary").groupBy("part").applyInArrow(total, "part int, held binary").collect():  # 8 bytes a term
        out[part * PART : (part + 1) * PART] = np.frombuffer(held, np.int64)
    return out[: size - 1], int(out[size - 1])


def chi_square(held: list[tuple[int, dict[int, int]]], terms: int) -> np.ndarray:
    """Chi-square of each term with the label over (label, term counts)."""
    n1 = float(sum(y for y, _ in held))
    n, yes, every = float(len(held)), np.zeros(terms), np.zeros(terms)
    for y, c in held:
        every[list(c)] += 1
        if y:
            yes[list(c)] += 1
    no, n0 = every - yes, n - n1
    below = every * (n - every) * n0 * n1
    cross = yes * (n0 - no) - no * (n1 - yes)
    return np.where(below > 0, n * cross * cross / np.where(below > 0, below, 1), 0.0)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 3, is_held_out: int = 1, per_class: int = PER_CLASS) -> Index:
    prepare(docs.sparkSession)
    examples, shares = training(docs, labels, column, modulus, is_held_out, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["doc_id", "label", "t", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = examples.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label int, t array<string>, n array<int>").collect()  # at most 2 * per_class
    vocabulary = sorted({t for r in rows for t in r[2]})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = [(r[0], r[1], {number[t]: n for t, n in zip(r[2], r[3], strict=True)}) for r in rows]
    held, n = document_frequencies(docs, vocabulary)
    chi2 = chi_square([x[1:] for x in counted], len(vocabulary))
    return Index(vocabulary, np.log(1 + n / (1 + held)) * (EASE + chi2 / (chi2 + HALF)), counted, shares)


def score(docs: DataFrame, index: Index, modulus: int = 3, is_held_out: int = 1, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_doc_id, evidence_similarity, evidence_terms for each row of docs."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        number = {t: i for i, t in enumerate(index.vocabulary)}
        for batch in batches:
            found = list(index.judge([{number[w]: n for w, n in words_of(t.as_py()).items() if w in number} for t in batch.column(1)]))
            evidence = pa.array([f[1] for f in found], batch.column(0).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), evidence, pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.string())], names=["doc_id", "score", "evidence_doc_id", "evidence_similarity", "evidence_terms"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence_doc_id {kind}, evidence_similarity double, evidence_terms string")
    held_out = F.coalesce(F.pmod(crc_text(F.col("doc_id")), F.lit(modulus)) == is_held_out, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"), "evidence_doc_id", "evidence_similarity", "evidence_terms")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
