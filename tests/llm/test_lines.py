import numpy as np

from foliospark.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(texts):
    """Texts after all pairs of lines are held against each other."""
    places = {}
    for d in sorted(texts):
        for n, line in enumerate((texts[d] or "").split("\n")):
            if form := L.normal(line):
                places.setdefault(form, []).append((d, n))
    forms = list(places)
    parent = list(range(len(forms)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(forms):
        for j in range(i):
            g = forms[j]
            if abs(len(f) - len(g)) * 10 <= max(len(f), len(g)) and distance(f, g) <= int((1 - L.SIMILARITY + 1e-9) * max(len(f), len(g))):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, f in enumerate(forms):
        groups.setdefault(root(i), []).extend(places[f])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {d: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in texts.items()}


def case():
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(10**5)}"
    lines = [" ".join(word() for _ in range(int(rng.integers(2, 12)))) for _ in range(60)]
    long_ = [" ".join(f"v{i}x{k % 40}" for k in range(150)) for i in range(3)]
    out = {}
    for d in range(30):
        own = [str(rng.choice(lines)) for _ in range(4)] + [word() for _ in range(2)]
        if d % 5 == 0:
            x = long_[d % 3].split(" ")
            x[0], x[1] = (x[1], x[0]) if d % 2 else (x[0], "other")
            own.append(" ".join(x))
        if d % 4 == 0:
            own[0] = own[0].upper() + "!"
        own.insert(2, "")
        out[d] = "\n".join(own)
    return out


def test_same_as_brute_force(make):
    texts = case()
    rows = L.dedup(make(list(texts.items())).repartition(3)).collect()
    assert {r.doc_id: r.text for r in rows} == brute(texts)
    assert sum(r["n_removed"] for r in rows) > 30


def test_normal_form():
    assert L.normal("  Ünï—12,345 Things! ") == "uni 0 0 things" and L.normal(" -- ") == ""


def test_lines_of_a_batch_are_as_alone():
    """Keys, forms and fingerprints don't depend on what else a batch holds."""
    texts = ["One two, 33 four\n\n-- \nÉté “déjà” vu…", "", "x", "one TWO 44 four\n" + "word " * 300 + "end\n日本 語 7,8"]
    lines = L.Lines([L.fold(t) for t in texts])
    found = [(t, n, lines.form(i)) for i, (t, n) in enumerate(zip(lines.text.tolist(), lines.number.tolist(), strict=True))]
    assert found[:4] == [(0, 0, "one two 0 four"), (0, 3, "ete deja vu"), (2, 0, "x"), (3, 0, "one two 0 four")] and found[5] == (3, 2, "日本 語 0 0")
    assert lines.key[0] == lines.key[3] and len(set(lines.key.tolist())) == 5 and lines.size.tolist() == [len(f) for _, _, f in found]
    prints, blocks = L.fingerprints(lines, np.arange(6))
    for i, (_, _, form) in enumerate(found):
        alone = L.Lines([form])
        p, b = L.fingerprints(alone, np.arange(1))
        assert alone.key[0] == lines.key[i] and p[0] == prints[i] and set(b[0].tolist()) == set(blocks[i].tolist())


def test_distance_by_bit_vectors():
    rng = np.random.default_rng(21)
    for _ in range(400):
        x = "".join(rng.choice(list("ab é"), int(rng.integers(0, 40))))
        y = "".join(rng.choice(list("ab é"), int(rng.integers(0, 40)))) if rng.integers(2) else x[: int(rng.integers(0, 30))] + "b" + x[5:]
        assert L.distance(x, y) == distance(x, y)
    x = "".join(rng.choice(list("abc"), 700))
    y = x[:300] + "ccc" + x[310:]
    assert L.distance(x, y) == distance(x, y)


def test_long_texts_are_read_in_pieces(make, monkeypatch):
    texts = case()
    whole = {r.doc_id: r.text for r in L.dedup(make(list(texts.items()))).collect()}
    import foliospark.llm.line_dedup as home

    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})
    one = [(i, n + k, L.normal(x)) for ids, firsts, parts in home._pieces(batch) for i, n, t in zip(ids, firsts, parts, strict=True) for k, x in enumerate(t.split("\n"))]
    monkeypatch.setattr(home, "PIECE", 60)
    many = [(i, n + k, L.normal(x)) for ids, firsts, parts in home._pieces(batch) for i, n, t in zip(ids, firsts, parts, strict=True) for k, x in enumerate(t.split("\n"))]
    assert one == many and whole.keys() == texts.keys()


def test_odd_rows(odd, none):
    rows = L.dedup(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: r.text for r in rows}
    assert by[1] is None and by[2] == "" and by[None].startswith("text without") and by[4].startswith("word") and by[5] == "" and by[8] == "a b c d e f g h"
    assert L.dedup(none).count() == 0 and L.dedup(odd).columns[: len(odd.columns)] == odd.columns


def edited(rng, form, whole):
    """form with about a tenth of its characters changed: whole words, or single characters."""
    words = form.split(" ")
    left = len(form) // 10
    for k in rng.permutation(len(words)):
        if whole and len(words[k]) <= left:
            left -= len(words[k])
            words[k] = "".join(rng.choice(list("xyz"), len(words[k])))
        elif not whole and left:
            left -= 1
            words[k] = "z" + words[k][1:]
    return " ".join(words)


def test_edited_lines_are_found(make):
    """Lines with a tenth of their characters changed, against edit similarity alone: short ones all, longer ones (whole words) 95 % at least."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 9))))
    lines = [" ".join(word() for _ in range(int(n))) for n in rng.integers(1, 60, 400)]
    lines = [x for x in lines if len(x) >= 10]
    copies = [edited(rng, x, len(x) > L.SHORT) for x in lines]
    changed = [i for i, (x, y) in enumerate(zip(lines, copies, strict=True)) if x != y]
    assert all(distance(x, y) * 10 <= len(x) for x, y in zip(lines, copies, strict=True))
    rows = L.dedup(make([*enumerate(lines), *enumerate(copies, 1000)]).repartition(3)).collect()
    removed = {r.doc_id - 1000 for r in rows if r.n_removed}
    assert removed <= set(range(len(lines))) and removed >= {i for i in changed if len(lines[i]) <= L.SHORT}
    assert len(removed & set(changed)) >= 0.95 * len(changed)


def test_segments_lose_no_short_pair():
    rng = np.random.default_rng(12)
    seen = 0
    for _ in range(1500):
        form = "".join(rng.choice(list("abc"), int(rng.integers(8, L.SHORT + 1))))
        other = list(form)
        for _ in range(int(rng.integers(1, 5))):
            k = int(rng.integers(len(other)))
            other[k : k + int(rng.integers(0, 2))] = ["", "a", "b"][rng.integers(3)]
        other = "".join(other)
        if other != form and len(other) <= L.SHORT and distance(form, other) * 10 <= max(len(form), len(other)):
            seen += 1
            assert L.segments(form) & L.segments(other)
    assert seen > 300


def test_members_of_a_hot_group_unlike_its_first_are_found(make):
    """Lines of one SimHash and the same first pieces: a template and the same short words in another order."""
    rng = np.random.default_rng(13)
    template = " ".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(7))
    words = [c * 3 for c in "klmnopqrstuv"]
    orders = [rng.permutation(12) for _ in range(2200)]
    texts = {i: f"{template} {' '.join(words[k] for k in o)}" for i, o in enumerate(orders)}
    copies = {10_000 + i: f"{template} {' '.join(words[k] for k in [o[1], o[0], *o[2:]])}" for i, o in enumerate(orders[-40:])}
    rows = L.dedup(make([*texts.items(), *copies.items()]).repartition(3)).collect()
    removed = {r.doc_id for r in rows if r.n_removed}
    assert set(copies) <= removed and len(removed) < 200


def test_bags_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnorstu0_ éüжω漢字\U0001f600")
    texts = []
    for _ in range(400):
        a = "".join(rng.choice(letters, rng.integers(5, 150)))
        b = list(a)
        for _ in range(int(rng.integers(0, 9))):
            i = int(rng.integers(len(b))) if b else 0
            b[i : i + int(rng.integers(0, 2))] = rng.choice(letters, rng.integers(0, 2)).tolist()
        texts += [a, "".join(b)]
    lines = L.Lines(texts)
    bags = lines.bags(np.arange(len(lines.key))).view(np.uint64)
    at = {t: i for i, t in enumerate(lines.text.tolist())}
    held = 0
    for k in range(0, len(texts), 2):
        if k in at and k + 1 in at:
            a, b = lines.form(at[k]), lines.form(at[k + 1])
            assert int(np.bitwise_count(bags[at[k]] ^ bags[at[k + 1]]).sum()) + abs(len(a) - len(b)) <= 2 * distance(a, b)
            held += 1
    assert held > 350


def test_slices_of_a_group_send_no_pairs_of_unlike_letters():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    forms = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60, p=rng.dirichlet(np.full(26, 0.4)))) for _ in range(60)]
    forms += [f[:30] + "zq" + f[32:] for f in forms[:10]]
    lines = L.Lines(forms)
    bags = lines.bags(np.arange(len(forms)))
    columns = {"node": np.arange(len(forms)), "component": np.arange(len(forms)), "size": np.full(len(forms), 60, np.int32), "print": np.zeros(len(forms), np.int64)}
    made = L._between(pa.table({**columns, **{c: np.ascontiguousarray(bags[:, i]) for i, c in enumerate(L.BAG)}}))
    pairs = set(zip(made.column("a").to_pylist(), made.column("b").to_pylist(), strict=True))
    assert {(i, 60 + i) for i in range(10)} <= pairs and len(pairs) < 40  # of 2415 with equal SimHashes


def test_distances_side_by_side():
    rng = np.random.default_rng(21)
    pairs = [("", ""), ("", "a"), ("a", "b"), ("abcdefghij", "abcdefghi"), ("w " * 900, "w " * 880)]
    for letters in (list("abc"), list("abcdefgh éü"), [chr(0x4E00 + i) for i in range(400)]):
        for _ in range(150):
            a = "".join(rng.choice(letters, rng.integers(0, 160)))
            b = list(a)
            for _ in range(int(rng.integers(0, len(a) // 6 + 2))):
                i = int(rng.integers(len(b))) if b else 0
                b[i : i + int(rng.integers(0, 3))] = rng.choice(letters, rng.integers(0, 3)).tolist()
            pairs.append((a, "".join(b)))
    long_ = ["".join(rng.choice(list("abcd "), 1700)) for _ in range(10)]  # cells of two bytes
    pairs += [(x, x[: 40 * k] + x[80 * k :] + "ab" * (10 * k)) for k, x in enumerate(long_)]
    want = [L.distance(x, y) * 10 <= max(len(x), len(y)) for x, y in pairs]
    assert L.within([x for x, _ in pairs], [y for _, y in pairs]).tolist() == want and 100 < sum(want) < len(want) - 100
    assert L.within([x for x, _ in pairs[-10:]], [y for _, y in pairs[-10:]]).tolist() == want[-10:] and 0 < sum(want[-10:]) < 10


def test_unlike_pairs_of_a_large_group_are_not_written(make, monkeypatch):
    """Copies of one text, each edited in its own way, differ from each other in over a tenth: what is written grows with them, not with their pairs."""
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(60)]
    lines = []
    for _ in range(240):
        own = list(words)
        for k in rng.choice(60, 7, replace=False):
            own[k] = "".join(rng.permutation(list(own[k])))  # the same letters
        lines.append(" ".join(own))
    again = [x.replace(words[0], words[0][1:] + words[0][0]) for x in lines[:8]]
    pairs = sum(distance(x, y) * 10 > len(x) for x, y in zip(lines[:40], lines[40:80], strict=True))
    assert pairs > 20  # most don't link
    real, written = L.materialize, {}

    def counted(df, name="t", compression="zstd"):
        out = real(df, name, compression)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(L, "materialize", counted)
    rows = {r.doc_id: r.n_removed for r in L.dedup(make([*enumerate(lines), *enumerate(again, 1000)]).repartition(3)).collect()}
    texts = {**dict(enumerate(lines)), **dict(enumerate(again, 1000))}
    assert all(rows[1000 + i] for i in range(8)) and rows.keys() == texts.keys()
    for i in (i for i, n in rows.items() if n):  # what goes is linked to something
        assert any(L.within([texts[i]] * (len(texts) - 1), [texts[j] for j in texts if j != i]))
    assert max(n for k, n in written.items() if k not in ("members", "found")) <= 8 * len(texts), written


def test_members_of_groups_that_are_ruled_out_make_no_candidates(make, monkeypatch):
    """Lines that share blocks only, in large and in small groups: beyond one companion each, no pair is written that lengths, SimHashes and bags rule out."""
    rng = np.random.default_rng(31)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    common = [[word(14) for _ in range(4)] for _ in range(12)]
    lines = [" ".join([*common[i % (1 if i < 150 else 12)], *(word(9) for _ in range(4))]) for i in range(300)]
    similar = [x[:-1] + "0" for x in lines[:150:10]]
    real, written = L.materialize, {}

    def counted(df, name="t", compression="zstd"):
        out = real(df, name, compression)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(L, "materialize", counted)
    rows = {r.doc_id: r.n_removed for r in L.dedup(make([*enumerate(lines), *enumerate(similar, 1000)]).repartition(3)).collect()}
    assert {i for i, n in rows.items() if n} == {1000 + i for i in range(len(similar))}
    assert written["candidates"] <= len(lines) + len(similar), written
