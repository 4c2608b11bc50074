"""N-gram Jaccard join by universe-partition pigeonhole, and the connected groups of its links.

A text's words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; its set is that of its distinct
shingles of five words (all words as one shingle if there are fewer), as 64-bit hashes. Texts with equal sets are one node, named by the smallest
doc_id. Two nodes link if 100 * intersection >= 80 * union. Texts are cut into words once; all that follows reads the packed sets.

Index. Sizes fall into bands. For a band with largest size U two linked sets differ in at most H = 2U/9 shingles. The
universe of shingles is cut by a hash into m segments. Either a segment's content is one signature (then m - H
segments of a linked pair are the same) or it is that content and each content with one shingle left out (then m - H/2
segments are within one shingle, and share a signature). m is taken so large that a linked pair has TIMES such segments at least. `allocation` picks the kind and m of a band by expected cost. A set is indexed under its own band and under the next one if a partner can
be there. Empty (or, with deletions, single-shingle) segments say nothing and aren't indexed; a set with so many of them that the pigeonhole no
longer holds is *uncovered* and cut again by another hash, up to CUTS times. A linked pair shares signatures of TIMES segments of some cut unless both sets stay uncovered to the last.

Candidates. Signatures travel packed by hash bucket. A task sends of a signature that it has met on over SMALL nodes the smallest node only, and
the memberships aside, so that no bucket gathers a hot signature. What comes back is each node's smallest candidate and
the memberships (signature, node) of signatures that several nodes have: linear in the signatures, no pairs.
1. Each node is verified against its smallest candidate, and the links are contracted to components.
2. Signatures whose nodes are of one component are done. Of the others, those of up to SMALL nodes give their pairs of different components.
A pair that this leaves open shares TIMES segments that are all in larger ones: the rarest of them still joins the two if each node gives up
its most frequent signatures, of TIMES - 1 segments. That leaves few nodes and small groups; there are up to ROUNDS rounds.
Of a larger group one node is picked by a hash, and each node is held against one that is picked in any of its groups: one pair a node and round, and most of a family of copies is one component soon.
3. What is still larger and of several components is *hot*. A node with more than a fifth of its shingles in no other hot node links with none and is left
out (told by cells of half the universe, which shingles share, so that no other node is). The others are written as differences D(x) from a centre q (what half of a sample of
the nodes have): two sets differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles whatever q is. Either |D(x)| and |D(y)| alone are small enough, then both
are linked to the node with the least difference for its size, or linked nodes share some of their differences. A prefix filter over the
differences, by bands of |D| of the larger one and with shingles that q lacks first, rare ones before others, finds every such pair. Near copies of one text
differ from it each in its own way, and texts that share a passage each have a rest of their own, so that neither yields pairs that don't link.
4. Sets uncovered to the last meet by a prefix filter of their own.
In 3 and 4 pairs pass the parities of their shingles in 1024 cells, in the join itself. All candidates pass sizes and a sketch of 256 counts, more for longer sets. These only drop pairs that
can't link; what is left is verified exactly on the whole sets.

Nulls, empty texts and texts of separators have an empty set and link with nothing; their component is their own doc_id. doc_id is of an integer type and
names a document: rows that share one are one node of the graph. A row without a doc_id has a null component. Repeated rows are copies like others; very long texts have long
sets and no other treatment; ties don't arise, as the smallest doc_id names a group. Extra columns aren't read by the join and pass by in `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm._common import materialize, mix, prepare, release, shingle_hashes, table, word_hashes
from foliospark.llm.components import connected_components

SIZE, NUM, DEN = 5, 80, 100
GROWTH = 1.5
#: What a shingle of an uncovered set costs, in signatures: it is cut once more.
UNCOVERED = 2
SMALL = 8
#: Segments that a linked pair has in common at least (the number of a segment is a signature's lowest byte); rounds of step 2.
TIMES, ROUNDS = 4, 3
ANY_SEGMENT = 255
#: Cuts of the universe that an uncovered set goes through.
CUTS = 4
#: Signatures of a bucket, about; signatures that a task gathers before it sends them on.
BUCKET, FLUSH = 400_000, 500_000
#: Counters that order the shingles of hot groups, and how many of them one row holds.
COUNTERS, COUNTER_PART = 1 << 20, 1 << 14
#: Nodes of a hot group, about, that make its centre.
SAMPLE = 6
#: Numbers of 64 parity bits of a set.
PARITIES = 16
_U = np.uint64


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), SIZE))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    n, m = len(a), len(b)
    if not n or not m or DEN * min(n, m) < NUM * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return DEN * shared >= NUM * (n + m - shared)


@lru_cache
def bands(upto: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return tuple(out)


@lru_cache(maxsize=4096)
def allocation(band: int) -> tuple[int, int, int]:
    """Segments m, kind (0: whole contents, 1: with one-deletion neighbourhoods), and how many useless segments a set of this band may have.

    The cost of an option is its signatures, plus the prefix filter's work times the share of sets that would be uncovered
    (a segment's size taken as Poisson, the number of useless segments as normal; half the sets as small as a visitor from the band below).
    """
    low, top = bands()[band], bands()[band + 1] - 1
    size = (low + top) / 2
    most = 2 * top * (DEN - NUM) // (DEN + NUM)

    def uncovered(m: int, kind: int, spare: int, size: float) -> float:
        mean = size / m
        useless = math.exp(-mean) * (1 + (mean if kind else 0))
        return 0.5 * math.erfc((spare + 0.5 - m * useless) / math.sqrt(m * useless * (1 - useless) + 1e-9) / math.sqrt(2))

    best = None
    for kind in (0, 1):
        need = most // (kind + 1) + TIMES
        for slack in range(0, 101, 4):
            m = need + math.ceil(need * slack / 100)
            missed = (uncovered(m, kind, m - need, max(1, low * NUM / DEN)) + uncovered(m, kind, m - need, size)) / 2
            cost = m + kind * size + missed * UNCOVERED * (20 + size)
            if best is None or cost < best[0]:
                best = (cost, m, kind, m - need)
    return best[1:]


def _numbered(sig: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return (sig & _U(0xFFFFFFFFFFFFFF00)) | segment


def signatures(shingles: np.ndarray, cut: int = 0) -> tuple[np.ndarray, bool]:
    """The signatures of a set by one cut of the universe, and whether it is covered in each band that it stands in."""
    n = len(shingles)
    first = bands()
    own = int(np.searchsorted(first, n, side="right")) - 1
    out, covered = [], True
    with np.errstate(over="ignore"):
        for band in (own, own + 1, own + 2):
            if band > own and DEN * n < NUM * first[band]:
                break
            m, kind, spare = allocation(band)
            salt = _U(((band + 1) * 0x9E3779B97F4A7C15 + cut * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
            h = mix(shingles ^ salt)
            segment = ((h >> _U(32)) * _U(m)) >> _U(32)
            order = np.argsort(segment, kind="stable")
            segment, h = segment[order], mix(h[order])
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sums = np.add.reduceat(h, starts)
            name = mix(segment[starts] * _U(0xD6E8FEB86659FD93) + salt)
            number = segment[starts] if m <= ANY_SEGMENT else np.full(len(starts), ANY_SEGMENT, _U)
            if kind:
                sizes = np.diff(np.append(starts, n))
                fat = sizes > 1
                covered &= m - int(fat.sum()) <= spare
                spread = np.repeat(np.arange(len(starts)), sizes)
                keep = fat[spread]
                out.append(_numbered(mix(sums ^ name), number))
                out.append(_numbered(mix((sums[spread] - h)[keep] ^ name[spread][keep]), number[spread][keep]))
            else:
                covered &= m - len(starts) <= spare
                out.append(_numbered(mix(sums ^ name), number))
    return np.concatenate(out), covered


def all_signatures(shingles: np.ndarray) -> tuple[np.ndarray, bool]:
    """Signatures of as many cuts as it takes until the set is covered, and whether it is at last."""
    out = []
    for cut in range(CUTS):
        found, covered = signatures(shingles, cut)
        out.append(found)
        if covered:
            break
    return np.unique(np.concatenate(out)), covered


# ------------------------------------------------------------------ plan parts

#: Cells of the sketch of a set of under SKETCHED shingles: how many of its shingles fall into each. Each doubling of the set doubles them, so that long sets are told apart too.
CELLS, SKETCHED = 256, 2048
#: What a cell counts up to (half a byte); what is beyond is known from the set's size.
FULL = 15


def sketch(shingles: np.ndarray) -> bytes:
    cells = CELLS << (len(shingles) // SKETCHED).bit_length()
    held = np.minimum(np.bincount((shingles & _U(cells - 1)).astype(np.int64), minlength=cells), FULL).astype(np.uint8)
    return (held[0::2] | held[1::2] << 4).tobytes()


def counts_of(sketches: list[bytes], cells: int) -> np.ndarray:
    """The cells of sketches of one length, a row each, folded to so many."""
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    held = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(sketches), -1)
    while held.shape[1] > cells:
        held = np.minimum(held[:, : held.shape[1] // 2] + held[:, held.shape[1] // 2 :], FULL)
    return held


def may_link(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False only for pairs that can't link: the cells' smaller counts, and what is beyond full cells, add up to an upper bound of the intersection."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64) + np.minimum(na - a.sum(axis=1, dtype=np.int64), nb - b.sum(axis=1, dtype=np.int64))
    return (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & (DEN * most >= NUM * (na + nb - most))


def may_link_each(na: np.ndarray, nb: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """may_link for sketches of any lengths."""
    out = np.zeros(len(na), bool)
    by: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        by.setdefault((len(x), len(y)), []).append(i)
    for sizes, at in by.items():
        cells = 2 * min(sizes)
        out[at] = may_link(na[at], nb[at], counts_of([a[i] for i in at], cells), counts_of([b[i] for i in at], cells))
    return out


#: Bytes of a shingle in a packed set; two sets of a thousand have a chance of 4e-9 to share one by accident.
SET_BYTES = 6
#: Sets of so many shingles and more are packed without their highest bytes, which 256 counts (4 bytes each) give.
COUNTED = 2048


def _pack(x: np.ndarray) -> bytes:
    """The high bytes of a sorted set, still in order; its length tells the form (a multiple of SET_BYTES, or one byte more)."""
    if len(x) < COUNTED:
        return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :]).tobytes()
    counts = np.bincount((x >> _U(56)).astype(np.int64), minlength=256).astype(np.uint32).tobytes()
    out = counts + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES : 7]).tobytes()
    return out + bytes((1 - len(out)) % SET_BYTES)


def _unpack(x: bytes) -> np.ndarray:
    if len(x) % SET_BYTES == 0:
        out = np.zeros((len(x) // SET_BYTES, 8), np.uint8)
        out[:, 8 - SET_BYTES :] = np.frombuffer(x, np.uint8).reshape(-1, SET_BYTES)
        return out.view(np.uint64).ravel()
    counts = np.frombuffer(x, np.uint32, 256)
    n = int(counts.sum())
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - SET_BYTES : 7] = np.frombuffer(x, np.uint8, n * (SET_BYTES - 1), 1024).reshape(n, SET_BYTES - 1)
    out[:, 7] = np.repeat(np.arange(256, dtype=np.uint8), counts)
    return out.view(np.uint64).ravel()


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), print (128 bits of the set), sketch, set (its sorted hashes)."""
    import xxhash

    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id must be of an integer type, not {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()) for t in batch.column(1)]
            columns = ([len(s) for s in found], pa.int64()), ([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), ([sketch(s) for s in found], pa.binary()), ([_pack(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, k) for x, k in columns)], names=["doc_id", "n", "print", "sketch", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print binary, sketch binary, set binary")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: what they share compresses away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


PACK, MEMBER, FIRST, BARE = 0, 1, 2, 3
#: Bytes of a signature inside its bucket: a bucket's size is bounded, so that few differ only beyond them (and pairs are verified).
SIG_BYTES = 5
_LOW = _U((1 << 8 * SIG_BYTES) - 1)
_FOUND = "kind int, node long, other long"


def _runs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by signature and node, starts and sizes of the runs of one signature."""
    order = np.lexsort((node, sig))
    sig = sig[order]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    return order, start, np.diff(np.append(start, len(sig)))


def _shared(name: np.ndarray, node: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind, node, other of the runs `of`: all memberships, and for each node its smallest companion."""
    inside = np.repeat(of, size)
    low = np.repeat(node[start], size)[inside]
    members, names = node[inside], name[inside]
    order = np.lexsort((low, members))
    b, a = members[order], low[order]
    once = np.append(True, b[1:] != b[:-1]) if len(b) else np.empty(0, bool)
    b, a = b[once], a[once]
    b, a = b[a < b], a[a < b]
    return np.concatenate([np.full(len(members), MEMBER), np.full(len(b), FIRST)]), np.concatenate([members, b]), np.concatenate([names, a])


def met_in_buckets(rows: DataFrame, of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, bool]]], buckets: int) -> DataFrame:
    """kind, node, other for the (node, signatures, covered) that `of` makes of rows: what several nodes have in common.

    MEMBER: node has signature other, and so has another node. FIRST: other is the smallest companion of node in a signature. BARE: node isn't covered.
    Tasks send packs of signatures by bucket; of signatures that are hot in a task the memberships and companions, in any bucket.
    """
    schema = "kind int, node long, other long, bucket int, sigs binary, nodes binary, stars binary"
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["kind", "node", "other", "bucket", "sigs", "nodes", "stars"]

    def rows_of(kind: np.ndarray, node: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(kind), 100_000):
            part = [pa.array(x[a : a + 100_000].astype(t)) for x, t in ((kind, np.int32), (node, np.int64), (other, np.int64))]
            place = pa.array((part[1].to_numpy() % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part, place, *(pa.nulls(len(part[0]), k) for k in kinds[4:])], names=names)

    def flush(sigs: list, nodes: list) -> Iterator[pa.RecordBatch]:
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order, start, size = _runs(sig, node)
        sig, node = sig[order], node[order]
        bucket = ((sig >> _U(32)) * _U(buckets)) >> _U(32)  # sorted, since sig is
        big = size > SMALL
        star = np.zeros(len(sig), np.uint8)
        if big.any():
            name = (bucket << _U(8 * SIG_BYTES) | (sig & _LOW)).astype(np.int64)
            yield from rows_of(*_shared(name, node, start, size, big))
            star[start[big]] = 1
            keep = np.repeat(~big, size)
            keep[start] = True
            sig, node, star, bucket = sig[keep], node[keep], star[keep], bucket[keep]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        low = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES])
        ends = [*cuts[1:].tolist(), len(sig)]
        made = [(PACK, None, None, int(bucket[a]), low[a:b].tobytes(), _planes(node[a:b]), star[a:b].tobytes()) for a, b in zip(cuts.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, held, bare = [], [], 0, []
        for batch in batches:
            for node, s, covered in of(batch):
                if not covered:
                    bare.append(node)
                sigs.append(s)
                nodes.append(np.full(len(s), node, np.int64))
                held += len(s)
                if held >= FLUSH:
                    yield from flush(sigs, nodes)
                    sigs, nodes, held = [], [], 0
        if held:
            yield from flush(sigs, nodes)
        yield from rows_of(np.full(len(bare), BARE), np.array(bare, np.int64), np.zeros(len(bare), np.int64))

    return rows.mapInArrow(run, schema).groupBy("bucket").applyInArrow(_met_in_bucket, _FOUND)


def _signed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Of node and set: the node's signatures, and whether it is covered."""
    for node, packed_set in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield node, *all_signatures(_unpack(packed_set.as_py()))


def _met_in_bucket(rows: pa.Table) -> pa.Table:
    """kind, node, other: what the signatures of one bucket have in common."""
    import pyarrow.compute as pc

    names = ["kind", "node", "other"]
    is_pack = pc.equal(rows.column("kind"), PACK)
    passed, rows = rows.filter(pc.invert(is_pack)).select(names), rows.filter(is_pack)
    if not rows.num_rows:
        return passed
    sigs, nodes = [], []
    for sig, node in zip(rows.column("sigs").to_pylist(), rows.column("nodes").to_pylist(), strict=True):
        wide = np.zeros((len(sig) // SIG_BYTES, 8), np.uint8)
        wide[:, :SIG_BYTES] = np.frombuffer(sig, np.uint8).reshape(-1, SIG_BYTES)
        sigs.append(wide.view(np.uint64).ravel())
        nodes.append(_from_planes(node))
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order, start, size = _runs(sig, node)
    sig, node = sig[order], node[order]
    once = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
    if not once.all():  # a node may come from several tasks
        sig, node = sig[once], node[once]
        _, start, size = _runs(sig, node)
    bucket = rows.column("bucket")[0].as_py()
    name = (_U(bucket << 8 * SIG_BYTES) | sig).astype(np.int64)
    kind, node, other = _shared(name, node, start, size, size > 1)
    return pa.concat_tables([passed, pa.table([pa.array(kind.astype(np.int32)), pa.array(node), pa.array(other)], names=names)])


#: Rows (16 bytes each) up to which the nodes that are asked for are broadcast to pick their sets out of all; beyond, a shuffle join picks them.
BROADCAST_NODES = 1_000_000
#: Ids of documents that go, or that several rows have, up to which they are broadcast to the texts (some 50 bytes each in a hash table).
BROADCAST_IDS = 2_000_000
#: Bytes of centres up to which they are broadcast to their nodes; beyond, a shuffle join brings them together.
BROADCAST_BYTES = 32_000_000


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set and what nodes has besides, for the documents in nodes (node: a doc_id that stands for its set)."""
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    return sets.where("n > 0").select(F.col("doc_id").alias("node"), "set").join(nodes, "node")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches don't rule out. Sizes come first, so that few sketches are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = may_link_each(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows

    pairs = sent(materialize(pairs.select("a", "b"), "candidates"))
    for c in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}")), c)
    pairs = materialize(pairs.where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)").select("a", "b", "na", "nb"), "sized")
    asked = reps.join(sent(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi")
    for c in "ab":
        pairs = pairs.join(asked.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")), c)
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _facing(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, set_a and the columns of pairs with the set of b: b's set goes to a, which may be a hub, by a join whose hot partition can be split."""
    far = _only(sets, pairs.withColumnRenamed("b", "node")).withColumnRenamed("node", "b")
    hubs = _only(sets, pairs.select(F.col("a").alias("node")).distinct()).select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    return hubs.join(far, "a")


def _verified(sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, held = a, _unpack(x.as_py())
                ok.append(linked(held, _unpack(y.as_py())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    pairs = materialize(pairs.select("a", "b"), f"{name}-pairs")
    return materialize(_facing(sets, pairs).select("a", "b", "set_a", "set").mapInArrow(check, "a long, b long").distinct(), f"{name}-links")


def _with_component(rows: DataFrame, components: DataFrame, node: str, as_: str) -> DataFrame:
    c = components.select(F.col("node").alias(node), F.col("component").alias(as_))
    if components.count() <= BROADCAST_NODES:
        c = F.broadcast(c)
    return rows.join(c, node, "left").withColumn(as_, F.coalesce(as_, node))


def _open_groups(placed: DataFrame, k: int) -> DataFrame:
    """The rows (sig, node, component) of groups of several components, with the node picked by hash k (pivot, of) and the group's size (times, hot).

    Groups are made of the rows that are exchanged for the join, so that there is one exchange, of the rows alone.
    """
    rows = placed.select("sig", "node", "component").repartition("sig")
    pivot = F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "component")).alias("p")
    groups = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot, F.count("*").alias("times"))
    groups = groups.where("low <> high").select("sig", F.col("p.node").alias("pivot"), F.col("p.component").alias("of"), "times", (F.col("times") > SMALL).alias("hot"))
    return rows.join(groups, "sig")


def _pairs_of(members: DataFrame) -> DataFrame:
    """Pairs a < b of different components of small groups; members: sig, node, component."""
    x, y = (members.select("sig", F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    return x.join(y, "sig").where("a < b and ca <> cb").select("a", "b").distinct()


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITIES numbers of 64 bits, each bit telling whether an odd number of shingles fall on it: two sets differ in no less shingles than bits."""
    place = (shingles >> _U(16)) % _U(64 * PARITIES)
    odd = (np.bincount(place.astype(np.int64), minlength=64 * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _parities(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, p0 to p15 for nodes (node)."""
    names = [f"p{i}" for i in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpack(x.as_py()) for x in batch.column(1)]
            bits = np.array([parity(x) for x in found], np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITIES))], names=["node", "n", *names])

    return materialize(_only(sets, nodes).select("node", "set").mapInArrow(run, ", ".join(f"{c} long" for c in ["node", "n", *names])), "parities")


def _pairs_by_key(found: DataFrame, components: DataFrame, parities: DataFrame) -> DataFrame:
    """Pairs a < b of different components, one of role 1 and one of role 2, under one key, that parities don't rule out; found: met_in_buckets of 4 * node + roles (each key of a node once)."""
    rows = found.where(f"kind = {MEMBER}").select(F.col("other").alias("key"), F.expr("node >> 2").alias("node"), F.expr("node & 3").alias("roles"))
    rows = _with_component(rows, components, "node", "component").repartition("key").distinct()  # one exchange, for what follows too
    shared = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bit_or("roles").alias("all"))
    rows = rows.join(shared.where("low <> high and all = 3").select("key"), "key", "left_semi").join(parities, "node")
    rows = materialize(rows, "keys")
    x, y = (rows.where(F.expr(f"roles & {r} > 0")).select("key", *(F.col(c).alias(f"{c}_{r}") for c in rows.columns if c not in ("key", "roles"))) for r in (1, 2))
    apart = " + ".join(f"bit_count(p{i}_1 ^ p{i}_2)" for i in range(PARITIES))
    fit = f"component_1 <> component_2 and {DEN} * least(n_1, n_2) >= {NUM} * greatest(n_1, n_2) and {DEN + NUM} * ({apart}) <= {DEN - NUM} * (n_1 + n_2)"
    met = x.join(y, (x["key"] == y["key"]) & F.expr(fit))
    return met.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


@lru_cache
def difference_bands(upto: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands of differences."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * 1.3)))
    return np.array(out, np.int64)


def difference_prefixes(x: np.ndarray, q: np.ndarray, often: np.ndarray) -> tuple[int, list[tuple[int, int, np.ndarray]]]:
    """|D| of a sorted set x against its centre q, and (band, roles, shingles): what x shares with a linked partner that differs from q by no less (1) or no more (2), or either (3).

    Linked sets of sizes n and m differ in at most (n + m) / 9 shingles, so in n / 4. With D >= E the sizes of both differences,
    they share at least (D + E - n / 4) / 2 elements of their differences, and at least D - n / 4; pairs with D + E <= (n + m) / 9 may share none.
    """
    added, removed = np.setdiff1d(x, q, assume_unique=True), np.setdiff1d(q, x, assume_unique=True)
    added = added[np.lexsort((added, often[_cell(added)]))]
    diff = np.concatenate([added, removed])  # one order for all sets with this centre
    d, most, first = len(diff), len(x) // 4, difference_bands()
    if not d:
        return 0, []
    band = int(np.searchsorted(first, d, side="right")) - 1
    less = most // 2 + 1
    out = [(band, 3, diff[:less]), (band, 2, diff[less : most + 1])]
    band += 1
    while first[band] <= d + most:
        out.append((band, 1, diff[: (d - int(first[band]) + most) // 2 + 1]))
        band += 1
    return d, [x for x in out if len(x[2])]


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle, by COUNTERS counters that shingles share; they only order what is compared."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(held, _cell(_unpack(x.as_py())), 1)
        parts = [x for x in enumerate(held.reshape(-1, COUNTER_PART)) if x[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["part", "held"])

    def total(rows: pa.Table) -> pa.Table:
        held = np.zeros(COUNTER_PART, np.int64)
        for x in rows.column("held"):
            held += np.frombuffer(x.as_py(), np.int32)
        return pa.table([rows.column("part").slice(0, 1), pa.array([np.minimum(held, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["part", "held"])

    out = np.zeros(COUNTERS, np.int32)
    for part, held in sets.select("set").mapInArrow(count, "part int, held binary").groupBy("part").applyInArrow(total, "part int, held binary").collect():  # 4 MB
        out[part * COUNTER_PART : (part + 1) * COUNTER_PART] = np.frombuffer(held, np.int32)
    return out


#: Cells that tell shingles of several sets, at most at once (a bit each for the tasks); 2 ** PART_BITS of them are counted together.
MOST_CELLS, PART_BITS = 1 << 28, 16


def _half(x: np.ndarray, bits: int) -> np.ndarray:
    """The cells, of 2 ** bits, of those shingles of a set that lie in one half of the universe."""
    return mix(x[(x >> _U(20)) & _U(1) == 0]) >> _U(64 - bits)


def has_company(n: int, cells: np.ndarray, common: np.ndarray) -> bool:
    """False only if a set of n shingles can't link: of what is in it a linked set lacks a fifth at most. common: a bit for each cell, set where several sets fall into it."""
    alone = len(cells) - int((common[cells >> _U(3)] >> (_U(7) - (cells & _U(7))).astype(np.uint8) & 1).sum())
    return DEN * alone <= (DEN - NUM) * n


def _common(sets: DataFrame, nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2 ** bits cells: whether shingles of the nodes' sets fall into it more than once."""
    part = min(bits, PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate([np.empty(0, _U), *held]))
            starts = np.flatnonzero(np.append(True, cells[1:] >> _U(part) != cells[:-1] >> _U(part)))[: len(cells)]
            low = (cells & _U((1 << part) - 1)).astype(np.uint16)
            ends = np.append(starts[1:], len(cells))[: len(cells)]
            parts = (cells[starts] >> _U(part)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(parts), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["part", "held"])

        for batch in batches:
            for x in batch.column(0):
                held.append(_half(_unpack(x.as_py()), bits))
                n += len(held[-1])
                if n >= 2 * FLUSH:
                    yield flush()
                    held, n = [], 0
        yield flush()

    def total(rows: pa.Table) -> pa.Table:
        times = np.zeros(1 << part, np.int64)
        for x in rows.column("held"):
            times += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=1 << part)
        return pa.table([rows.column("part").slice(0, 1), pa.array([np.packbits(times > 1).tobytes()], pa.binary())], names=["part", "held"])

    out, width = np.zeros(1 << bits - 3, np.uint8), 1 << part - 3
    for k, held in _only(sets, nodes).select("set").mapInArrow(run, "part int, held binary").groupBy("part").applyInArrow(total, "part int, held binary").toLocalIterator():
        out[k * width : (k + 1) * width] = np.frombuffer(held, np.uint8)
    return out


def _in_company(sets: DataFrame, asked: DataFrame, reps: DataFrame) -> DataFrame:
    """The nodes (node) b of asked but for those that have more than a fifth of their shingles alone.

    Texts that share a passage have a rest of their own, so that few of them stay. Pivots a are taken in as many slices as keep the cells within MOST_CELLS.
    """
    sized = asked.join(reps.select(F.col("rep").alias("b"), "n"), "b")
    weight = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = -(-weight // MOST_CELLS)
    bits = min(MOST_CELLS, max(1 << 12, -(-weight // max(1, slices)))) - 1
    bits = bits.bit_length()
    left = asked.select(F.col("b").alias("node")).where("1 = 0")
    for k in range(slices):
        part = asked.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k)
        nodes = materialize(part.select(F.col("b").alias("node")).distinct(), "nodes")
        sent = sets.sparkSession.sparkContext.broadcast(_common(sets, nodes, bits))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = (_unpack(x.as_py()) for x in batch.column(1))
                ok = [has_company(len(x), _half(x, bits), sent.value) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["node"])

        left = left.unionAll(materialize(_only(sets, nodes).select("node", "set").mapInArrow(run, "node long"), "kept"))
        sent.unpersist()
    return left.distinct()


def _asked(hot: DataFrame) -> DataFrame:
    """a, b: each node b of hot groups (node, pivot, of) under one pivot a for each component of its pivots."""
    pivots = hot.groupBy("of").agg(F.min(F.struct(F.xxhash64("pivot").alias("h"), "pivot"))["pivot"].alias("a"))
    asked = hot.select("of", F.col("node").alias("b")).distinct().join(pivots, "of").select("a", "b")
    return materialize(asked.unionAll(pivots.select("a", F.col("a").alias("b"))).distinct(), "asked")


def _centres(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """a, centre: of each pivot a (asked has its nodes b) the shingles that half of a sample of its nodes have; any set would do, a good one leaves small differences."""
    size = asked.groupBy("a").agg(F.count("*").alias("k"))
    some = asked.join(size, "a").where(f"pmod(xxhash64(b), k) < {SAMPLE} or b = a").select("a", F.col("b").alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def centre() -> tuple[int, bytes]:
            shingles, times = np.unique(np.concatenate(held), return_counts=True)
            return last, _pack(shingles[2 * times >= len(held)])

        def batch_of(made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["a", "centre"])

        for batch in batches:
            made = []
            for a, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if a != last:
                    if held:
                        made.append(centre())
                    last, held = a, []
                held.append(_unpack(x.as_py()))
            yield batch_of(made)
        if held:
            yield batch_of([centre()])

    rows = _only(sets, some).select("a", "set").repartition("a").sortWithinPartitions("a")
    return materialize(rows.mapInArrow(run, "a long, centre binary"), "centres", "none")


def _differences(sets: DataFrame, asked: DataFrame, centres: DataFrame, often: Callable[[], np.ndarray]) -> DataFrame:
    """a, b, n, d (size of the difference of b from the centre of a), keys1, keys2, keys3 (by role) for each row of asked."""
    names = ["a", "b", "n", "d", "keys1", "keys2", "keys3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q = None, None
        for batch in batches:
            sizes, ds, made = [], [], ([], [], [])
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, q = a, _unpack(x.as_py())
                s = _unpack(y.as_py())
                d, prefixes = difference_prefixes(s, q, often())
                sizes.append(len(s))
                ds.append(d)
                keys: dict[int, list] = {1: [], 2: [], 3: []}
                for band, role, shingles in prefixes:
                    keys[role].append(mix(shingles ^ mix(np.array([a * 1024 + band], np.int64).astype(_U))))
                for role, found in keys.items():
                    made[role - 1].append(np.concatenate(found).tobytes() if found else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ds, pa.int64()), *(pa.array(m, pa.binary()) for m in made)], names=names)

    far = _only(sets, asked.withColumnRenamed("b", "node"))
    if centres.agg(F.coalesce(F.sum(F.octet_length("centre")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        centres = F.broadcast(centres)
    both = far.join(centres, "a").select("a", F.col("node").alias("b"), "centre", "set")
    return materialize(both.mapInArrow(run, "a long, b long, n long, d long, keys1 binary, keys2 binary, keys3 binary"), "differences", "none")


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Of b, keys1, keys2, keys3: 4 * b + roles and the keys."""
    for b, *keys in zip(batch.column(0).to_pylist(), *batch.columns[1:4], strict=True):
        for role, x in enumerate(keys, 1):
            if x := x.as_py():
                yield 4 * b + role, np.frombuffer(x, _U), True


def _smallest(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Of node and set: 4 * node + 3 and, in both roles, the smallest hashes of the set, of which linked sets have one in common."""
    for node, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        s = _unpack(x.as_py())
        yield 4 * node + 3, mix(s[: len(s) - -(-NUM * len(s) // DEN) + 1]), True


def join_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of docs."""
    prepare(docs.sparkSession)
    sets = materialize(sets_of(docs), "sets", "none")
    reps = materialize(sets.where("n > 0 and doc_id is not null").groupBy("print", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "reps")
    picked = reps.select(F.col("rep").alias("doc_id"), "print")
    own = sets.select("doc_id", "print", "set").join(F.broadcast(picked) if picked.count() <= BROADCAST_NODES else picked, ["doc_id", "print"], "left_semi")
    # A doc_id with rows of several sets is one node; where another document stands for one of them, the two are linked.
    several = sets.join(reps.select("print", F.col("n").alias("m"), "rep"), "print").where("doc_id <> rep").select("doc_id", "rep").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(64, math.ceil(1.4 * total / BUCKET))
    found = materialize(met_in_buckets(own.select(F.col("doc_id").alias("node"), "set"), _signed, buckets), "found")
    bare = materialize(found.where(f"kind = {BARE}").select("node").distinct(), "bare")
    # 1. Each node against its smallest candidate; what that connects needs no other pair.
    first = found.where(f"kind = {FIRST}").groupBy(F.col("node").alias("b")).agg(F.min("other").alias("a"))
    links = _verified(sets, _likely(first, reps), "first").unionAll(materialize(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "several"))
    components = materialize(connected_components(links), "components")
    # 2. Signatures that nodes of several components have.
    members = found.where(f"kind = {MEMBER}").select("node", F.col("other").alias("sig"))
    written = [first]
    for k in range(ROUNDS):
        placed = materialize(_with_component(members, components, "node", "component"), "placed")
        joined = materialize(_open_groups(placed, k), "members")
        release(placed, *written)
        stars = joined.where("hot and component <> of").groupBy(F.col("node").alias("b")).agg(F.min(F.struct(F.xxhash64("pivot", F.lit(k)).alias("h"), "pivot"))["pivot"].alias("a"))
        pairs = _pairs_of(joined.where("not hot")).unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = _verified(sets, _likely(pairs, reps), "near")
        links = links.unionAll(new)
        components = materialize(connected_components(links), "components")
        members = joined.where("hot").select("sig", "node", "pivot", "times")
        if k == 0:
            # Linked nodes share TIMES segments: the rarest common signature stays if each gives up its most frequent ones, of less segments.
            members = _with_component(members, components, "node", "component")
            several = members.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
            upto = Window.partitionBy("node").orderBy(F.desc("times"), "sig")
            given = F.size(F.collect_set(F.expr("sig & 255")).over(upto))
            counted = F.max(F.expr("sig & 255")).over(Window.partitionBy("node")) < ANY_SEGMENT
            members = members.join(several, "sig", "left_semi").withColumns({"given": given, "counted": counted}).where((F.col("given") >= TIMES) | ~F.col("counted"))
        members = materialize(members.select("sig", "node", "pivot"), "members")
        written = [joined]
        if k == ROUNDS - 1 or k and new.isEmpty():
            break
        written, members = [joined, members], members.select("sig", "node")
    # 3. Hot ones that still hold several components, by differences from a centre; one for each component of the pivots.
    hot = _with_component(_with_component(members, components, "node", "component"), components, "pivot", "of")
    hot = materialize(hot, "hot")
    release(found, members, *written)
    open_ = hot.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    hot = hot.join(open_, "sig", "left_semi")
    asked = _asked(hot)
    if asked.limit(1).count():  # groups of those that stay have other pivots, in common more often
        kept = materialize(_in_company(sets, asked, reps), "kept")
        kept = F.broadcast(kept) if kept.count() <= BROADCAST_NODES else kept
        asked = _asked(materialize(_open_groups(hot.join(kept, "node", "left_semi"), ROUNDS), "hot"))
    if asked.limit(1).count():
        sent = docs.sparkSession.sparkContext.broadcast(_frequencies(_only(sets, asked.select(F.col("b").alias("node")).distinct())))
        differences = _differences(sets, asked, _centres(sets, asked), lambda: sent.value)
        spare = (DEN + NUM) * F.col("d") - (DEN - NUM) * F.col("n")  # two nodes are linked for certain if theirs add up to 0 at most
        by_spare = differences.select("a", "b", spare.alias("spare"))
        least = by_spare.groupBy("a").agg(F.min(F.struct("spare", "b")).alias("z"))
        certain = by_spare.join(least, "a").where("spare + z.spare <= 0 and b <> z.b").select(F.col("z.b").alias("a"), "b")
        links = links.unionAll(materialize(certain.distinct(), "certain"))
        components = materialize(connected_components(links), "components")
        met = met_in_buckets(differences.select("b", "keys1", "keys2", "keys3"), _keyed, max(64, math.ceil(100 * asked.count() / BUCKET)))
        met = materialize(met, "keys")
        parities = _parities(sets, asked.select(F.col("b").alias("node")).distinct())
        release(differences)
        links = links.unionAll(_verified(sets, _likely(_pairs_by_key(met, components, parities), reps), "hot"))
        components = materialize(connected_components(links), "components")
    # 4. Sets that no cut covers.
    if bare.limit(1).count():
        met = materialize(met_in_buckets(_only(sets, bare).select("node", "set"), _smallest, 64), "bare")
        links = links.unionAll(_verified(sets, _likely(_pairs_by_key(met, components, _parities(sets, bare)), reps), "bare"))
        components = materialize(connected_components(links), "components")
    named = _with_component(reps, components, "rep", "component").select("print", F.col("n").alias("n2"), "component")
    out = sets.select("doc_id", "n", "print").join(materialize(named, "named"), "print", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out = materialize(out, "groups")
    release(sets, reps)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked, directly or not, to one with a smaller doc_id; rows without a doc_id stay.

    Of rows with one doc_id and the same text one stays; rows with one doc_id and different texts all stay.
    """
    # Documents that go and ids with several rows are few: their ids go to the texts, not the texts to all ids.
    groups = join_groups(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("__fs_id"))
    marks = groups.agg(F.min("component_id").alias("of"), F.count("*").alias("rows")).where("of <> __fs_id or rows > 1")
    marks = materialize(marks.select("__fs_id", (F.col("of") == F.col("__fs_id")).alias("__fs_many")), "marks")
    named = docs.join(F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks, docs["doc_id"] == F.col("__fs_id"), "left")
    many = named.where("__fs_many").withColumn("__fs_text", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "__fs_text"])
    return named.where("__fs_many is null").select(docs.columns).unionByName(many.select(docs.columns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
