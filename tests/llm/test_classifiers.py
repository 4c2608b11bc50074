import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import quality_classifier as Q, toxicity as T

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ran", "mel", "tip", "sog") for c in ("e", "a", "us")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(make, spark):
    """Good prose, three kinds of junk; an insult or none."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        t = prose(rng, int(rng.integers(20, 120)))
        bad, toxic = i % 6 == 0, i % 5 == 1
        if toxic:
            t = t.replace(" ", f" {rng.choice(['zzfool', 'zzrot', 'vilebag'])} ", 1)
        if bad:
            t = (t.upper().replace(" ", "!! "), t.replace(" ", "$$$ "), " ".join([t.split()[0]] * 80))[i // 6 % 3]
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, x) for i, q, x in labels}


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_never_used(corpus):
    docs, labels, _ = corpus
    crc = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(5))
    turned = labels.withColumn("quality", F.when(crc == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, x)).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_blocked_neighbours_are_exact(corpus):
    docs, labels, _ = corpus
    model = Q.fit(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()]
    x = Q.matrix(texts, model.weights)
    got = model.scores(x)
    for row, score in zip(x, got, strict=True):
        v = row @ model.fold
        cos = model.examples @ (v / np.linalg.norm(v))
        near = np.argsort(-cos, kind="stable")[: Q.K]
        w = np.maximum(cos[near], 0) ** Q.POWER * model.votes[near]
        assert abs((w @ model.labels[near]) / w.sum() - score) < 1e-3


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = T.score(docs, T.fit(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.97 * len(held)
    assert any(r.evidence_terms for r in rows if r.predicted)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    terms = [f"t{i}" for i in range(40)]
    examples = [(i, int(rng.integers(2)), {int(t): int(rng.integers(1, 5)) for t in rng.choice(40, rng.integers(1, 8), replace=False)}) for i in range(1000)]
    examples += [(2000 + i, y, c) for i, y, c in examples[:200]]  # ties
    index = T.Index(terms, rng.random(40) + 0.1, examples, {0: 500, 1: 700})
    vectors = {i: dict(zip(*map(np.ndarray.tolist, index.vector(c)), strict=True)) for i, _, c in examples}
    for _ in range(60):
        t, w = index.vector({int(t): 1 for t in rng.choice(40, rng.integers(1, 6), replace=False)})
        every = sorted((-round(sum(x * v.get(y, 0) for y, x in zip(t.tolist(), w.tolist(), strict=True)), 12), i) for i, v in vectors.items())
        want = [(s, i) for s, i in every if s < 0][: T.K]
        got = index.nearest(t, w)
        assert [index.ids[e] for _, e in got] == [i for _, i in want] and np.allclose([-s for s, _ in got], [s for s, _ in want], atol=1e-9)


def test_toxicity_against_brute_force(corpus):
    """Scores and evidence of whole rows, from counts, document frequencies and cosines made again here."""
    docs, labels, truth = corpus
    index = T.fit(docs, labels)
    texts = {r.doc_id: T.words_of(r.text) for r in docs.collect()}
    ids = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1]  # fewer than the cap: all are examples
    vocabulary = sorted({w for i in ids for w in texts[i]})
    assert vocabulary == index.vocabulary and sorted(index.ids) == ids
    df = {w: sum(w in c for c in texts.values()) for w in vocabulary}
    n1 = sum(truth[i][1] for i in ids)
    weight = {}
    for w in vocabulary:
        a = sum(w in texts[i] for i in ids if truth[i][1])
        b = sum(w in texts[i] for i in ids) - a
        n, n0 = len(ids), len(ids) - n1
        cross, below = a * (n0 - b) - b * (n1 - a), (a + b) * (n - a - b) * n0 * n1
        chi2 = n * cross**2 / below if below else 0.0
        weight[w] = np.log(1 + len(texts) / (1 + df[w])) * (T.EASE + chi2 / (chi2 + T.HALF))

    def vector(c):
        v = {w: (1 + np.log(k)) * weight[w] for w, k in c.items() if w in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i in ids}
    share = {1: n1 / len(ids), 0: 1 - n1 / len(ids)}
    got = {r.doc_id: r for r in T.score(docs, index).collect()}
    for i in sorted(texts)[::11]:
        v = vector(texts[i])
        near = sorted((-round(sum(x * vectors[j].get(w, 0) for w, x in v.items()), 12), j) for j in ids)[: T.K]
        near = [(-s, j) for s, j in near if s < 0]
        w = [s * s for s, _ in near]
        vote = (sum(x * truth[j][1] for x, (_, j) in zip(w, near, strict=True)) + T.SMOOTH * share[1]) / (sum(w) + T.SMOOTH)
        logit = np.log(np.clip(vote, 1e-3, 0.999) / (1 - np.clip(vote, 1e-3, 0.999)))
        assert abs(got[i].score - 1 / (1 + np.exp(-index.curve[0] - index.curve[1] * logit))) < 1e-6
        assert got[i].evidence_doc_id == near[0][1] and abs(got[i].evidence_similarity - near[0][0]) < 1e-9


def test_toxicity_is_calibrated(corpus):
    docs, labels, truth = corpus
    held = [r for r in T.score(docs, T.fit(docs, labels)).collect() if r.held_out]
    assert abs(np.mean([r.score for r in held]) - np.mean([truth[r.doc_id][1] for r in held])) < 0.05
    for low, high in ((0, 0.2), (0.8, 1.01)):
        part = [r for r in held if low <= r.score < high]
        assert not part or abs(np.mean([r.score for r in part]) - np.mean([truth[r.doc_id][1] for r in part])) < 0.1


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (8, None, None), (None, 1, 1), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    empty = labels.where("1 = 0")
    for docs, known, n in ((odd, labels, 10), (odd, empty, 10), (none, labels, 0), (none, empty, 0)):
        a, b = Q.score(docs, Q.fit(docs, known)).collect(), T.score(docs, T.fit(docs, known)).collect()
        assert len(a) == len(b) == n and all(0 <= r.score <= 1 for r in (*a, *b))
