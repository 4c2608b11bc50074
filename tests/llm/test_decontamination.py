import numpy as np
import pytest

from foliospark.llm import decontamination as D


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"q{x}" for x in rng.integers(0, 500, n))) for i, n in enumerate((8, 12, 20, 20, 35, 60))]
    rows += [(6, "one two three"), (7, None), (8, "..."), (9, rows[2][1])]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def brute(index, text):
    """Best similarity over all windows of each item's size, without SimHash."""
    words = D.words_of(text)
    n_words = len(words[0])
    out = {}
    for j, length in enumerate(index.lengths.tolist()):
        size = min(D.SIZE, length)
        if n_words < size:
            continue
        h, w = D.shingles_of(words, size if length < D.SIZE else D.SIZE)
        span = min(max(1, length - D.SIZE + 1), len(h))
        best = max(index.similarity(h[p : p + span], w[p : p + span], j) for p in range(len(h) - span + 1))
        if best >= D.THRESHOLD - 1e-12:
            out[index.ids[j]] = round(best, 9)
    return out


def test_same_as_all_windows(items, make):
    rows, table = items
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(120):
        w = [f"q{x}" for x in rng.integers(0, 500, rng.integers(5, 80))]
        item = rows[i % 6][1].split()
        for _ in range(i % 3):  # edits inside the passage
            item[rng.integers(len(item))] = "edit"
        if i % 4 == 1:
            item.insert(len(item) // 2, "more")
        cut = rng.integers(len(w))
        texts[i] = " ".join(w[:cut] + (item if i % 2 else []) + w[cut:])
    texts[500] = "One, TWO; three!"
    texts[501] = rows[5][1].upper().replace(" ", ", ")
    index = D.Index([(i, t) for i, t in rows if t])
    got = {}
    for r in D.leaks(make(list(texts.items())), table).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = round(r.similarity, 9)
    assert got == {i: b for i, t in texts.items() if (b := brute(index, t))}
    assert len(got) > 10 and got[501] == {5: 1.0} and got[500] == {6: 1.0}


def test_slices_change_nothing(items, make, spark, monkeypatch):
    """Items by the slice, with ids of text."""
    rows, table = items
    docs = make([(i, f"before it {t} and after") for i, t in rows if t] + [(50, None), (51, "")])
    named = table.selectExpr("concat('item ', item_id) AS item_id", "text")
    once = sorted(D.leaks(docs, named).collect())
    monkeypatch.setattr(D, "SLICE_ROWS", 3)
    assert once == sorted(D.leaks(docs, named).collect()) and len(once) >= 8 and {r.item_id for r in once} >= {"item 2", "item 9"}
    monkeypatch.setattr(D, "SLICE_ROWS", 100)
    monkeypatch.setattr(D, "SLICE_BYTES", 200)
    assert once == sorted(D.leaks(docs, named).collect())
    assert {r.doc_id for r in D.clean(docs, named).collect()} == {50, 51} | ({i for i, t in rows if t} - {r.doc_id for r in once})


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    index = D.Index([(i, " ".join(f"a{x}" for x in rng.integers(0, 10**6, 30))) for i in range(50)])
    base = index.prints
    for j in range(50):
        p = base[j].copy()
        p[rng.choice(D.BITS, D.RADIUS, replace=False)] ^= True
        near = {k for k in range(50) if (p != base[k]).sum() <= D.RADIUS}
        found = {k for b, (lo, hi) in enumerate(zip(index.edges, index.edges[1:], strict=False)) for k in index.blocks[b].get(int(index._value(p[None], lo, hi)[0]), np.array([], int)).tolist()}
        assert near <= found


def test_planted_passages_in_the_test_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    squash = lambda t: " ".join(t.split())
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if squash(b.text) in squash(d.text)}
    assert whole <= {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}


def test_odd_rows(items, odd, none):
    _, table = items
    assert D.leaks(odd, table).count() == 0 and D.leaks(none, table).count() == 0
    assert D.leaks(odd, table.where("1 = 0")).count() == 0
    kept = D.clean(odd, table)
    assert kept.columns == odd.columns and kept.count() == odd.count() and D.clean(none, table).count() == 0
