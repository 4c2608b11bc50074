import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing as M, sharding as S


def test_rates_reach_the_target(make, spark):
    docs = make([(i, "t", "en", "big" if i < 4000 else "small") for i in range(5000)])
    got = {r.source: r["count"] for r in M.replicate(docs, {"big": 0.5, "small": 0.5}).groupBy("source").count().collect()}
    assert abs(got["big"] - 2500) < 5 * math.sqrt(2500) and abs(got["small"] - 2500) < 5 * math.sqrt(2500)


@pytest.mark.parametrize("mean", [0.3, 4.0, 40.0])
def test_counts_are_poisson(make, mean):
    docs = make([(i, "t", "en", "a") for i in range(3000)] + [(10_000 + i, "t", "en", "b") for i in range(int(3000 * (mean * 2 - 1)) if mean > 0.5 else 10)])
    share = mean * 3000 / docs.count()
    drawn = {r.doc_id: r.n_copies for r in M.replicate(docs, {"a": share, "b": max(0.0, 1 - share)}).where("source = 'a'").collect()}
    n = np.array([drawn.get(i, 0) for i in range(3000)])
    assert abs(n.mean() - mean) < 5 * math.sqrt(mean / 3000) and 0.85 < n.var() / mean < 1.15


def test_copies_and_odd_rows(odd, none, make):
    rows = M.replicate(odd).collect()
    assert all(1 <= r["__fs_copy"] <= r.n_copies for r in rows)  # a column named copy is there already
    assert M.replicate(none).count() == 0
    docs = make([(1, "a", "en", None), (2, "b", "en", "x")])
    assert {r.source for r in M.replicate(docs, {"x": 1.0}).collect()} <= {"x"}
    again = M.replicate(odd).select("doc_id", "shuffle_key")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, M.replicate(odd.repartition(5)).select("doc_id", "shuffle_key").collect()))


def test_matrix_has_its_margins():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 500, 64)
    m = S.draw_matrix(counts, 16, 3)
    assert (m.sum(axis=1) == counts).all() and m.min() >= 0 and np.ptp(m.sum(axis=0)) <= 1
    many = np.array([S.draw_matrix(np.array([30, 70]), 4, s)[0] for s in range(2000)])
    # Each entry is hypergeometric: mean 30/4, variance n K (N-K)(N-n) / N^2(N-1).
    assert abs(many[:, 0].mean() - 7.5) < 0.2 and abs(many[:, 0].var() - 30 * 0.25 * 0.75 * 70 / 99) < 0.4
    assert (S.draw_matrix(np.zeros(5, int), 3, 1) == 0).all()


def test_big_counts_are_drawn():
    m = S.draw_matrix(np.array([3_000_000_000, 2_000_000_001]), 4, 1)
    assert m.sum(axis=1).tolist() == [3_000_000_000, 2_000_000_001] and np.ptp(m.sum(axis=0)) <= 1


def test_shards_and_slots(make):
    docs = make([(i, f"text {i % 7}") for i in range(1003)])
    rows = S.assign(docs).select("doc_id", "assigned_shard", "assigned_slot").collect()
    by = {}
    for r in rows:
        by.setdefault(r.assigned_shard, []).append(r.assigned_slot)
    assert len(rows) == 1003 and len(by) == 16 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = S.assign(docs.repartition(7)).select("doc_id", "assigned_shard", "assigned_slot").collect()
    assert sorted(rows) == sorted(again)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.assigned_shard, r.assigned_slot))]
    assert abs(np.corrcoef(order, range(1003))[0, 1]) < 0.12


def test_copies_are_dealt_like_other_rows(make):
    """Of four copies of a document all fall into one of 16 shards as often as in a uniform shuffle (1 in 4096), and hardly ever into neighbouring slots."""
    docs = make([(i, f"text {i}") for i in range(3000)] * 4)
    for rows_each in (S.ROWS_EACH, 500):
        by = {}
        for r in S.assign(docs, rows_each=rows_each).select("doc_id", "assigned_shard", "assigned_slot").collect():
            by.setdefault(r.doc_id, []).append((r.assigned_shard, r.assigned_slot))
        assert all(len(set(v)) == 4 for v in by.values())
        assert sum(len({s for s, _ in v}) == 1 for v in by.values()) <= 6
        pairs = sum(a[0] == b[0] for v in by.values() for k, a in enumerate(v) for b in v[:k])
        assert abs(pairs - 18000 / 16) < 5 * np.sqrt(18000 / 16)
        near = sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for v in by.values() for k, a in enumerate(v) for b in v[:k])
        assert near <= 15


def test_a_content_of_a_third_of_all_rows(make):
    docs = make([(i, f"text {i}") for i in range(4000)] + [(7, "again")] * 2000)
    rows = S.assign(docs, rows_each=200).collect()
    by = {}
    for r in rows:
        by.setdefault(r.assigned_shard, []).append(r.assigned_slot)
    assert len(rows) == 6000 and all(sorted(v) == list(range(375)) for v in by.values())
    hot = np.bincount([r.assigned_shard for r in rows if r.text == "again"], minlength=16)
    assert hot.sum() == 2000 and abs(hot - 125).max() < 6 * np.sqrt(125)
    assert sorted(r.doc_id for r in rows if r.text != "again") == list(range(4000))


def test_native_plan(make):
    plan = S.assign(make([(1, "a")])).drop("none")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_columns(spark, sf, texts):
    rows = S.op4_uniform_shards(spark, sf).collect()
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)


def test_odd_rows_in_shards(odd, none):
    rows = S.assign(odd).collect()
    assert len(rows) == 10 and len({(r.assigned_shard, r.assigned_slot) for r in rows}) == 10
    assert S.assign(none).count() == 0
    assert S.assign(odd.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 10
