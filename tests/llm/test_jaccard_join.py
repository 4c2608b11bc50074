import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import components, jaccard_join as J


def brute(texts):
    sets = {i: J.shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if J.linked(sets[a], sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
    return w


def hard_case(seed):
    """Near copies with few and many edits, a large family, shared passages, tiny texts, exact copies."""
    rng = np.random.default_rng(seed)
    out, passage = [], words(rng, 25)
    for n in (6, 9, 14, 30, 80, 300, 900):
        base = words(rng, n)
        out += [base, base, base[: int(n * 0.9)], base + words(rng, max(1, n // 12))]
        out += [edited(rng, base, max(1, int(n * f))) for f in (0.01, 0.02, 0.03, 0.05)]
    family = words(rng, 200)
    out += [edited(rng, family, int(rng.integers(0, 8))) for _ in range(60)]
    out += [passage + words(rng, int(rng.integers(1, 60))) for _ in range(60)]
    chain = words(rng, 400)
    for _ in range(12):  # neighbours link, ends don't
        chain = chain[8:] + words(rng, 8)
        out.append(chain)
    order = rng.permutation(len(out))
    return {int(i): " ".join(out[j]) for i, j in enumerate(order)}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(make, seed):
    texts = hard_case(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_groups(make(list(texts.items())).repartition(3)).collect()}
    assert got == brute(texts)


def test_on_the_test_tables(make, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_groups(make(list(texts.items()))).collect()}
    assert got == brute(texts)


def test_odd_rows(odd, none):
    rows = J.join_groups(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and (by[1].n_shingles, by[1].component_id) == (0, 1) and by[2].component_id == 2
    assert by[5].component_id == 4 and by[None].component_id is None and by[8].n_shingles == 4
    assert J.join_groups(none).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert J.one_of_each(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6))
def test_covered_pairs_share_a_signature(n, less, more, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[min(less, len(a) - 1) :], rng.integers(0, 2**63, more).astype(np.uint64)]))
    if J.linked(a, b):
        (x, covered), (y, also) = J.signatures(a), J.signatures(b)
        if covered or also:
            segments = np.unique(np.intersect1d(x, y) & np.uint64(J.ANY_SEGMENT))
            assert len(segments) >= J.TIMES or J.ANY_SEGMENT in segments


@settings(max_examples=150, deadline=None)
@given(st.integers(20, 300), st.integers(0, 80), st.integers(0, 80), st.integers(0, 80), st.integers(0, 10**6))
def test_differences_of_linked_sets_share_a_key(n, from_pivot, shared, own, seed):
    rng = np.random.default_rng(seed)
    often = rng.integers(0, 3, J.COUNTERS).astype(np.int32)
    new = lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    q = np.unique(new(n))
    x = np.unique(np.concatenate([rng.permutation(q)[min(n - 1, from_pivot) :], new(shared)]))
    y = np.unique(np.concatenate([rng.permutation(x)[min(len(x) - 1, own // 4) :], new(own // 5)]))
    if J.linked(x, y) and len(np.setxor1d(x, y)):
        (dx, px), (dy, py) = J.difference_prefixes(x, q, often), J.difference_prefixes(y, q, often)
        if 9 * (dx + dy) > len(x) + len(y):  # else both are linked to the node with the least difference
            keys = lambda p, role: {(b, h) for b, r, s in p if r & role for h in s.tolist()}
            less, more = (px, py) if dx <= dy else (py, px)
            assert keys(less, 1) & keys(more, 2) or dx == dy and keys(more, 1) & keys(less, 2)


def test_candidates_of_a_large_family_are_linear(make, monkeypatch):
    """3000 near copies, a tenth of them just too far from the others: pairs that are verified stay within a few of each."""
    rng = np.random.default_rng(3)
    base = words(rng, 150)
    texts = [edited(rng, base, int(rng.integers(4, 9)) if i % 10 == 0 else int(rng.integers(1, 4))) for i in range(3000)]
    counts = {}
    write = J.materialize

    def counted(df, name="t", *more):
        out = write(df, name, *more)
        if name.endswith("-pairs"):
            counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(J, "materialize", counted)
    rows = J.join_groups(make([(i, " ".join(t)) for i, t in enumerate(texts)]).repartition(6)).collect()
    assert len(rows) == 3000 and sum(counts.values()) < 12 * 3000, counts
    largest = max({r.component_id: 0 for r in rows}, key=[r.component_id for r in rows].count)
    assert sum(r.component_id == largest for r in rows) > 2600


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    alone = {x for x in parent if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {x: root(x) for x in parent if x not in alone}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_of_kept_documents_are_not_exchanged(spark, make):
    """Ids go to the texts at any size of documents, however few bytes Spark itself would broadcast."""
    from foliospark.llm import jaccard_join as J

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "another text"), (3, "another text"), (4, "one id"), (4, "two texts"), (5, None), (None, text), (None, None), (6, "")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.one_of_each(make(rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([(1, text), (3, "another text"), (4, "one id"), (4, "two texts"), (5, None), (None, text), (None, None), (6, "")], key=repr)
    assert "SortMergeJoin" not in plan


def test_groups_are_made_of_rows_exchanged_once(spark, tmp_path):
    """Groups of signatures and the join with their members share one exchange."""
    rows = [(s, 100 * s + i, 100 * s + (i if s % 2 else 0)) for s in range(40) for i in range(2 + s % 12)]
    spark.createDataFrame(rows, "sig long, node long, component long").write.parquet(str(tmp_path / "placed"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J._open_groups(spark.read.parquet(str(tmp_path / "placed")), 0)
        found = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.sig, r.node, r.component) for r in found) == [r for r in rows if r[0] % 2]
    assert all(r.pivot // 100 == r.sig and r.of == r.pivot and r.times == 2 + r.sig % 12 and r.hot == (r.times > J.SMALL) for r in found)
    assert plan.replace("ReusedExchange", "").count("Exchange hashpartitioning(") - plan.count("ReusedExchange") == 1, plan


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9000), st.floats(0, 0.25), st.floats(0, 0.25), st.integers(0, 10**6))
def test_sketches_and_packs_of_long_sets(n, less, more, seed):
    """Linked sets pass at any size, unlike ones don't, and long sets take less than six bytes a shingle."""
    rng = np.random.default_rng(seed)
    new = lambda k: np.unique(rng.integers(0, 2**64, k, dtype=np.uint64))
    a = new(n)
    b = np.unique(np.concatenate([a[int(n * less) :], new(int(n * more))]))
    pass_ = lambda x, y: J.may_link_each(np.array([len(x)]), np.array([len(y)]), [J.sketch(x)], [J.sketch(y)])[0]
    assert pass_(a, b) or not J.linked(a, b)
    assert n < 100 or not pass_(new(n), new(n))
    back = J._unpack(J._pack(a))
    assert (back >> np.uint64(16) == a >> np.uint64(16)).all() and len(back) == len(a)
    assert n < 4000 or len(J._pack(a)) < 5.5 * n


def test_texts_that_share_a_passage_alone_are_not_compared(make, monkeypatch):
    """Of 400 texts with one passage and a rest of their own, and 40 near copies with it, no more than those copies and a few others get keys."""
    rng = np.random.default_rng(11)
    passage, base = words(rng, 60), words(rng, 200)
    texts = [passage + words(rng, 140) for _ in range(400)] + [passage + edited(rng, base, int(rng.integers(3, 9))) for _ in range(40)]
    counts = {}
    write = J.materialize

    def counted(df, name="t", *more):
        out = write(df, name, *more)
        if name == "differences":
            counts[name] = out.select("b").distinct().count()
        return out

    monkeypatch.setattr(J, "materialize", counted)
    texts = {int(i): " ".join(t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_groups(make(list(texts.items())).repartition(4)).collect()}
    assert got == brute(texts)
    assert counts.get("differences", 0) < 100, counts


@pytest.mark.parametrize("most", [J.MOST_CELLS, 4096])
def test_slices_of_hot_groups(make, monkeypatch, most):
    """Whatever the number of slices, the same groups as by brute force."""
    monkeypatch.setattr(J, "MOST_CELLS", most)
    rng = np.random.default_rng(12)
    passages = [words(rng, 40) for _ in range(6)]
    bases = [words(rng, 120) for _ in range(6)]
    texts = {i: " ".join(passages[i % 6] + edited(rng, bases[(i // 6) % 6] if i % 4 else words(rng, 120), int(rng.integers(0, 7)))) for i in range(240)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_groups(make(list(texts.items())).repartition(4)).collect()}
    assert got == brute(texts)
