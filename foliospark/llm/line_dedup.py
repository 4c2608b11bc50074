"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence for each connected group.

A line is a part of a text between newlines. Its normal form is its words, lower-cased, decomposed without accents, runs of digits
as 0, joined by single spaces; words are runs of ASCII letters, digits, underscores and characters beyond ASCII but for general punctuation and
Latin-1 symbols. Lines of one normal form are one node, named by 64 bits of its words' hashes. Two
nodes are linked if the edit similarity of their normal forms, 1 - Levenshtein / longer length, is at least SIMILARITY.
Of each group of connected nodes the occurrence with the smallest (doc_id, line) stays; all others are taken out of their texts.

A SimHash of 64 bits has each distinct word vote on each bit. One edited word flips about ten bits, so its own bits make poor blocks;
blocks are made by words instead: a hash deals a line's words to about a third as many blocks (a power of two, four at least; a line close below a change of
that number is dealt to both, one of four blocks twice by different hashes), and each block is the SimHash of its words alone. An edited word touches two blocks at most, so by the
pigeonhole principle lines that differ in fewer words than half of the blocks share one. Blocks of few letters say little and are left out, unless a line has no others. Where the
shorter line has up to SHORT characters, the longer one is cut into one segment more than edits can touch, and the shorter one is looked up
under all its substrings that can be such a segment: no pair of these is lost. Nodes that share a block are verified by their
edit distance, unless their lengths or bags rule it out, or both are longer than SHORT and their SimHashes differ in over FAR bits.

A bag counts a form's characters in 16 bins, modulo 16, each as eight bits of a Johnson counter: codes of counts i and j differ in as many bits as
there are steps from i to j around the circle, never more than |i - j|. An edit takes one character away, adds one, or both, so the bits in which two bags differ
and the difference in length are together at most twice the edit distance: bags rule out no similar pair, and all but few of the others.

Texts are read once, with numpy over the bytes of a batch. Every line of every text takes part. A node's occurrences are only counted and joined, never gathered: a line that stands
in a third of all documents is a hot key of a join, whose partition the adaptive planner can split. Blocks travel packed
by hash bucket; what comes back is each node's smallest companion and memberships (block, node). Nodes are held against their smallest companion; then, in
rounds, small groups give their pairs of different components, larger ones the pairs with one node picked by a hash: members travel with lengths, SimHashes and
bags, so that a pair which these rule out is not written. Rounds end when one joins little, as each reads all forms. What larger groups then still
hold in several components is compared in slices of their nodes, by lengths, SimHashes and bags, which names the nodes whose forms are needed, and then by edit
distance in the slice itself, which gives no more links than it has components: pairs are compared there but not written, and the size of a group changes no result.

Lines without a word are left alone and no occurrence of anything. Null texts stay null, empty ones empty; very long texts are read in pieces of whole
lines. Rows that share a doc_id are one document; rows without one are left alone and take no part. Equal lines are told apart by (doc_id, line). Extra
columns pass by in `dedup`; where they are named n_lines or n_removed the result's begin with __fs_.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import materialize, mix, prepare, release, table
from foliospark.llm.components import connected_components
from foliospark.llm.jaccard_join import BROADCAST_NODES, FIRST, MEMBER, met_in_buckets

SIMILARITY, SHORT, FAR = 0.9, 40, 20
#: Characters beyond which a form doesn't come along into slices; beyond which lines are compared by bit vectors, one pair at a time.
LONG, LONGEST = 1500, 10_000
#: Pairs that are compared side by side, and their characters; the least pairs for that; rows and pairs that are gathered.
LANES, CHARS, FEW, GATHERED = 2048, 6_000_000, 8, 8192
#: Antidiagonals between two looks at which pairs are decided.
LOOK = 32
#: Groups of a node by which a pair that shares several of them is left to one.
GROUPS = 16
#: Words a block, least characters of the distinct words of a block, share of the words from which a line is dealt to the next number of blocks too.
WORDS_EACH, LEAST_CHARS, CLOSE = 3, 10, 0.85
#: The number of blocks is 2 to this power at most (there are 12 bits for it, and 20 for the lines of a piece).
MOST_BITS = 11
SMALL, ROUNDS, SLICE, BUCKET = 8, 3, 4096, 400_000
#: Members for each link of a round from which another round isn't worth reading all forms once more.
RARE = 100
#: Bytes of text read at a time; words whose bits are spread out at a time (64 bytes each); nodes that a task remembers.
PIECE, WORDS_AT_ONCE, SEEN = 500_000, 100_000, 300_000
_U = np.uint64

# Classes of bytes. 0: between words, 1: in a word, 2: newline, 3: digit, 4: left out.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(97, 123), *range(65, 91), 95, *range(128, 256)]] = 1
_KIND[48:58], _KIND[10] = 3, 2
# Bins of a bag: twelve for a frequent letter each, four that the other ASCII characters share; characters beyond share all. Codes of 0 to 15.
_BIN = (12 + np.arange(256) % 4).astype(np.int64)
_BIN[[*b"etaoinsrhldu"]] = np.arange(12)
_STEP = np.array([(1 << i) - 1 for i in range(8)] + [0xFF & ~((1 << i) - 1) for i in range(8)], np.uint8)
BAG = ["bag0", "bag1"]


def fold(text: str) -> str:
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo 2 ** 64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 16)
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def _hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end], the same wherever the run stands."""
    p, inverse = powers(len(values) + 1)
    upto = np.zeros(len(values) + 1, _U)
    np.cumsum(values * p[:-1], out=upto[1:])
    return mix((upto[end] - upto[start]) * inverse[start] + (end - start).astype(_U))


class Lines:
    """The lines with a word of some folded texts: text (its place), number, key, first word and words; hash and characters of words; normal forms."""

    def __init__(self, folded: list[str]):
        data = np.frombuffer("\n".join(folded).encode("utf-8", "surrogatepass"), np.uint8)
        kind = _KIND[data]
        lead = np.flatnonzero((data == 0xCC) | (data == 0xCD))  # combining marks U+0300 to U+036F
        lead = lead[(data[lead] == 0xCC) | (data[lead + 1] < 0xB0)]
        kind[lead] = kind[lead + 1] = 4
        lead = np.flatnonzero(data == 0xC2)  # U+0080 to U+00BF
        kind[lead] = kind[lead + 1] = 0
        lead = np.flatnonzero(data == 0xE2)
        lead = lead[(data[lead + 1] == 0x80) | (data[lead + 1] == 0x81)]  # U+2000 to U+207F
        kind[lead] = kind[lead + 1] = kind[lead + 2] = 0
        digit = kind == 3
        if digit.any():
            again = digit.copy()
            again[1:] &= digit[:-1]
            again[:1] = False
            kind = np.where(again, 4, kind)
            data = np.where(digit, 48, data).astype(np.uint8)
        left_out = kind == 4
        if left_out.any():
            data, kind = data[~left_out], kind[~left_out]
        in_word = (kind == 1) | (kind == 3)
        edge = np.diff(in_word.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = _hash_runs(data.astype(_U) + _U(1), start, end)
        heads = np.zeros(len(data) + 1, np.int64)  # characters, not bytes
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        self.chars = heads[end] - heads[start]
        line = np.searchsorted(np.flatnonzero(kind == 2), start)
        self.first = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
        self.words = np.diff(np.append(self.first, len(line)))
        line = line[self.first]
        self.key = _hash_runs(self.hash, self.first, self.first + self.words).view(np.int64)
        offset = np.cumsum([0] + [t.count("\n") + 1 for t in folded])
        self.text = np.searchsorted(offset, line, side="right") - 1
        self.number = line - offset[self.text]
        upto = np.append(0, np.cumsum(self.chars))
        self.size = upto[self.first + self.words] - upto[self.first] + self.words - 1
        # Normal forms: words and one space behind each.
        kept = in_word.copy()
        kept[1:] |= in_word[:-1]
        places = np.append(0, np.cumsum(kept))
        self._bytes = np.where(in_word, data, 32)[kept].astype(np.uint8).tobytes()
        self._from, self._to = places[start[self.first]], places[end[self.first + self.words - 1]] if len(line) else places[:0]

    def form(self, i: int) -> str:
        return self._bytes[self._from[i] : self._to[i]].decode("utf-8", "surrogatepass")

    def pick(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes and characters of some lines one behind the other, and the place of the line of each."""
        n = self.words[lines]
        at = np.repeat(self.first[lines] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.hash[at], self.chars[at], np.repeat(np.arange(len(lines)), n)

    def bags(self, lines: np.ndarray) -> np.ndarray:
        """Two numbers for each of some lines: its characters in 16 bins, as codes of eight bits."""
        n = (self._to - self._from)[lines]
        at = np.repeat(self._from[lines] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        data = np.append(np.frombuffer(self._bytes, np.uint8)[at], np.zeros(3, np.uint8))
        head = np.flatnonzero((data[:-3] & 0xC0) != 0x80)
        owner = np.repeat(np.arange(len(lines)), n)[head]
        place = _BIN[data[head]]
        wide = np.flatnonzero(data[head] >= 0xC0)
        first = head[wide]
        code = data[first].astype(np.int64)
        for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            code = code * 67 + np.where(data[first] >= least, data[first + i], 0)
        place[wide] = (code * 0x9E3779B1 >> 16) % 16
        count = np.bincount(owner * 16 + place, minlength=len(lines) * 16).reshape(-1, 16)
        return np.ascontiguousarray(_STEP[count & 15]).view(np.int64)


def normal(line: str) -> str:
    """The normal form of one line; empty without a word."""
    found = Lines([fold(line)])
    return found.form(0) if len(found.key) else ""


def _added(rows: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of 64 numbers, each sum at most `most`; eight numbers of a byte are added at a time where that fits."""
    small = most < 256
    out = np.add.reduceat(rows.astype(np.uint8, copy=False).view(_U), start, axis=0).view(np.uint8).astype(np.int32)
    ends = np.append(start[1:], len(rows))
    for i in np.flatnonzero(~small).tolist():
        out[i] = rows[start[i] : ends[i]].sum(axis=0, dtype=np.int32)
    return out


def simhash_blocks(words: np.ndarray, chars: np.ndarray, owner: np.ndarray, blocks: np.ndarray, deal: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of each owner's words (all owners have some); the values of its blocks that have LEAST_CHARS, and their owners. blocks: their number, by owner."""
    number = blocks[owner].astype(_U)
    group = (((mix(words ^ _U(0xA24BAED4963EE407 + deal)) >> _U(32)) * number) >> _U(32)).astype(np.int64)
    key = owner.astype(_U) << _U(44) | group.astype(_U) << _U(32) | words >> _U(32)
    order = np.argsort(key)
    order = order[np.append(True, key[order[1:]] != key[order[:-1]])[: len(order)]]  # each word of a line votes once
    words, chars, owner, group = words[order], chars[order], owner[order], group[order]
    start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1]))[: len(owner)])
    size = np.diff(np.append(start, len(owner)))
    prints = np.empty(len(start), _U)
    ones = np.zeros((len(blocks), 64), np.int32)
    of = owner[start]
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + WORDS_AT_ONCE, side="right")) - 1)
        stop = start[b] if b < len(start) else len(owner)
        bits = np.unpackbits(words[start[a] : stop].view(np.uint8).reshape(-1, 8), axis=1)
        votes = _added(bits, start[a:b] - start[a], size[a:b])
        prints[a:b] = np.packbits(2 * votes > size[a:b, None], axis=1).view(_U).ravel()
        line = np.flatnonzero(np.append(True, of[a + 1 : b] != of[a : b - 1]))
        ones[of[a:b][line]] += _added(votes, line, np.add.reduceat(size[a:b], line))
        a = b
    whole = np.packbits(2 * ones > np.bincount(owner, minlength=len(blocks))[:, None], axis=1).view(_U).ravel()
    full = np.add.reduceat(chars, start) >= LEAST_CHARS if len(start) else np.empty(0, bool)
    full |= (np.bincount(of, full, len(blocks)) == 0)[of]  # a line of few distinct letters has no better ones
    place = (group[start] + (blocks[of] << 24) + (deal << 60)).astype(_U)
    return whole, mix(prints ^ mix(place))[full], of[full]


def fingerprints(lines: Lines, new: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """SimHash of each of the lines in new, and all values under which it is looked up."""
    if not len(new):
        return np.empty(0, _U), []
    words, chars, owner = lines.pick(new)
    n, size = lines.words[new], lines.size[new]
    blocks = 1 << np.clip( np.log2(np.maximum(n, 1) / WORDS_EACH + 1e-9).astype(np.int64), 2, MOST_BITS)
    prints, value, of = simhash_blocks(words, chars, owner, blocks)
    values, owners = [value], [of]
    close = (n >= CLOSE * 2 * blocks * WORDS_EACH) & (size > SHORT) & (blocks < 1 << MOST_BITS)
    few = (blocks == 4) & (size > SHORT)
    for also, number, deal in ((close, 2 * blocks, 0), (few, blocks, 1)):
        if also.any():
            _, value, of = simhash_blocks(*lines.pick(new[also]), number[also], deal)
            values.append(value)
            owners.append(np.flatnonzero(also)[of])
    value, of = np.concatenate(values), np.concatenate(owners)
    long_ = size[of] > SHORT
    value, of = value[long_], of[long_]
    short = np.flatnonzero(size <= SHORT * 10 // 9)
    own = [(x, i) for i in short.tolist() for x in segments(lines.form(int(new[i])))]
    value = np.concatenate([value, mix(np.array([x for x, _ in own], _U))])
    of = np.concatenate([of, np.array([i for _, i in own], np.int64)])
    order = np.argsort(of, kind="stable")
    value, ends = value[order], np.cumsum(np.bincount(of, minlength=len(new))).tolist()
    return prints, [value[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]  # np.split takes a microsecond and more for each


def segments(form: str) -> set[int]:
    """Pieces of 40 bits, one of which a form of up to SHORT characters shares with each longer (or as long) similar one."""
    n, found = len(form), set()
    for m in range(n, n * 10 // 9 + 1 if n <= SHORT else n + 1):
        edits = m // 10
        if not edits:
            continue
        cuts = [m * i // (edits + 1) for i in range(edits + 2)]
        for i in range(edits + 1):
            size = cuts[i + 1] - cuts[i]
            # What stands left of the first equal segment differs in at most i edits, what is right of it in at most edits - i.
            low = max(0, cuts[i] - i, cuts[i] + n - m - (edits - i))
            high = min(n - size, cuts[i] + i, cuts[i] + n - m + (edits - i))
            if m == n:
                found.add(_piece(m, i, form[cuts[i] : cuts[i + 1]]))
            if n <= SHORT:
                found.update(_piece(m, i, form[k : k + size]) for k in range(low, high + 1))
    return found


def _piece(m: int, i: int, part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), m << 8 | i) >> 24


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """doc_ids, numbers of the first lines and folded texts, of about PIECE characters; longer texts are cut between lines."""
    ids, firsts, texts, held = [], [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = text.as_py()
        if doc is None or not t:
            continue
        first = 0
        while t:
            cut = t.rfind("\n", 0, PIECE) if len(t) > PIECE else -1
            cut = t.find("\n", PIECE) if cut < 0 and len(t) > PIECE else cut
            part, t = (t[:cut], t[cut + 1 :]) if cut >= 0 else (t, "")
            ids.append(doc)
            firsts.append(first)
            texts.append(fold(part))
            first += part.count("\n") + 1
            held += len(part)
            if held >= PIECE:
                yield ids, firsts, texts
                ids, firsts, texts, held = [], [], [], 0
    if ids:
        yield ids, firsts, texts


SCANNED = "node long, doc_id long, line long, form string, print long, size int, blocks binary, " + ", ".join(f"{c} long" for c in BAG)


def _scan(docs: DataFrame) -> DataFrame:
    """In one reading of the texts: a row (node, doc_id, line) for each line with a word, and a row (node, form, print, size, blocks, bag) for each node that is new to the task."""
    names = ["node", "doc_id", "line", "form", "print", "size", "blocks", *BAG]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), *(pa.int64() for _ in BAG)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for ids, firsts, texts in _pieces(batch):
                lines = Lines(texts)
                keys, at = np.unique(lines.key, return_index=True)
                new = at[[k not in seen for k in keys.tolist()]] if len(keys) else at
                if len(seen) + len(new) > SEEN:
                    seen.clear()
                seen.update(lines.key[new].tolist())
                prints, blocks = fingerprints(lines, new)
                seen_rows = [pa.array(lines.key), pa.array(np.array(ids, np.int64)[lines.text]), pa.array(lines.number + np.array(firsts, np.int64)[lines.text])]
                yield pa.RecordBatch.from_arrays([*seen_rows, *(pa.nulls(len(lines.key), k) for k in kinds[3:])], names=names)
                node_rows = [pa.array([lines.form(i) for i in new.tolist()], pa.string()), pa.array(prints.view(np.int64)), pa.array(lines.size[new].astype(np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary()), *map(pa.array, lines.bags(new).T.copy())]
                yield pa.RecordBatch.from_arrays([pa.array(lines.key[new]), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.int64()), *node_rows], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
    for node, blocks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield node, np.unique(np.frombuffer(blocks.as_py(), _U)), True


def distance(x: str, y: str) -> int:
    """Levenshtein distance: columns of the table as bit vectors of differences, in integers as long as the shorter text."""
    if len(x) > len(y):
        x, y = y, x
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    n = len(a)
    head = int(np.argmin(np.append(a == b[:n], False)))
    tail = int(np.argmin(np.append(a[head:][::-1] == b[head:][::-1][: n - head], False)))
    a, b = a[head : n - tail], b[head : len(b) - tail]
    m = len(a)
    if not m:
        return len(b)
    full, last = (1 << m) - 1, 1 << (m - 1)
    places = {int(c): int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a)}
    up, down, score = full, 0, m
    for c in b.tolist():
        same = places.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        right = down | (full & ~(across | up))
        left = up & across
        score += 1 if right & last else -1 if left & last else 0
        right = right << 1 | 1
        up = full & (left << 1 | ~(level | right))
        down = full & right & level
    return score


def within(xs: list[str], ys: list[str]) -> np.ndarray:
    """Whether each pair's edit distance is at most a tenth of its longer length."""
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (xs, ys))
    most, apart = np.maximum(n, m) // 10, np.abs(n - m)
    ok = np.zeros(len(xs), bool)
    rest = np.flatnonzero(apart <= most)
    rest = rest[np.argsort((n + m)[rest], kind="stable")]
    while len(rest):
        at = rest[:LANES]
        at = at[: max(1, int((np.arange(1, len(at) + 1) * (n + m)[at] <= CHARS).sum()))]
        if len(at) < FEW or max(n[at].max(), m[at].max()) > LONGEST:
            at = at[:FEW]
            ok[at] = [distance(xs[i], ys[i]) <= most[i] for i in at.tolist()]
        else:
            ok[at] = _side_by_side([xs[i] for i in at.tolist()], [ys[i] for i in at.tolist()], most[at])
        rest = rest[len(at) :]
    return ok


def _side_by_side(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the distance of each pair is at most its `most`: the tables of all pairs by antidiagonals, a byte or two a cell.

    A path to the last cell that costs no more than `most` stays on diagonals up to (most + difference in length) / 2 from the first one.
    Pairs that are decided, or whose smallest values on two antidiagonals exceed their bound, are taken out.
    """
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (xs, ys))
    codes = np.frombuffer("".join([*xs, *ys]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 254:
        known, codes = np.unique(codes, return_inverse=True)
        codes = codes.astype(np.uint8 if len(known) < 254 else np.uint32)
    else:
        codes = codes.astype(np.uint8)
    top = np.iinfo(codes.dtype).max
    kind, far = (np.uint8, 200) if most.max() < 160 else (np.uint16, 50_000)  # far: too large a distance, with room for LOOK steps
    reach = max(1, int(((most + np.abs(n - m)) // 2).max()))
    last = int((n + m).max())
    front = reach + 2
    width = front + (last + reach) // 2 + 4

    def laid(codes: np.ndarray, n: np.ndarray, fill: int) -> np.ndarray:
        out = np.full((len(n), width), fill, codes.dtype)
        place = np.arange(width)
        out[(place >= front) & (place < front + n[:, None])] = codes
        return out.T

    cut = int(n.sum())
    x, y = np.ascontiguousarray(laid(codes[:cut], n, top)[::-1]), np.ascontiguousarray(laid(codes[cut:], m, top - 1))
    lane, ends, aim = np.arange(len(xs)), n + m, m - n
    ok = np.zeros(len(xs), bool)
    # Cells of diagonals -reach, -reach + 2 to reach, and of those between, with one beyond at either side.
    wide, between = np.full((reach + 1, len(xs)), far, kind), np.full((reach + 2, len(xs)), far, kind)
    (between[(reach + 1) // 2] if reach % 2 else wide[reach // 2])[:] = 0
    ok[ends == 0] = True
    held = np.empty_like(wide)
    unlike = np.empty(wide.shape, bool)
    by_end = np.argsort(ends, kind="stable")
    place = int(np.searchsorted(ends[by_end], 1))
    for s in range(1, last + 1):
        odd = (s + reach) & 1
        cells = reach if odd else reach + 1
        j, i = front + (s - reach + odd) // 2 - 1, width - 1 - front - (s + reach - odd) // 2 + 1
        now = between[1:-1] if odd else wide
        step, differ = held[:cells], unlike[:cells]
        beside = wide if odd else between
        np.minimum(beside[:-1], beside[1:], out=step)
        np.add(step, 1, out=step)
        np.not_equal(x[i : i + cells], y[j : j + cells], out=differ)
        np.add(now, differ.view(np.uint8), out=now)
        np.minimum(now, step, out=now)
        while place < len(by_end) and ends[by_end[place]] == s:
            k = by_end[place]
            ok[lane[k]] = now[(aim[k] + reach - odd) // 2, k] <= most[lane[k]]
            place += 1
        if s % LOOK == 0:
            np.minimum(wide, far, out=wide)
            np.minimum(between, far, out=between)
            alive = (ends > s) & (np.minimum(wide.min(axis=0), between.min(axis=0)) <= most[lane])
            if not alive.any():
                break
            if alive.sum() < 0.8 * len(alive):
                x, y, wide, between = (np.ascontiguousarray(t[:, alive]) for t in (x, y, wide, between))
                lane, ends, aim = lane[alive], ends[alive], aim[alive]
                held, unlike = np.empty_like(wide), np.empty(wide.shape, bool)
                by_end = np.argsort(ends, kind="stable")
                place = 0
    return ok


def _forms(forms: DataFrame, asked: DataFrame) -> DataFrame:
    """node, form of the nodes in asked (each once); the forms of others aren't exchanged while those asked for can be broadcast."""
    if asked.count() <= BROADCAST_NODES:
        asked = F.broadcast(asked)
    return materialize(forms.join(asked, "node", "left_semi").dropDuplicates(["node"]), "forms")


def _similar(pairs: DataFrame, prints: DataFrame, forms: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose normal forms are similar, by lengths, SimHashes and bags first."""
    held = pairs = materialize(pairs.select("a", "b"), "candidates")
    few = held.count() <= BROADCAST_NODES
    for c in "ab":
        own = prints.select(F.col("node").alias(c), F.col("print").alias(f"p{c}"), F.col("size").alias(f"z{c}"), *(F.col(x).alias(f"{x}{c}") for x in BAG))
        pairs = (F.broadcast(pairs) if few else pairs).join(own, c)
    apart = " + ".join(f"bit_count({x}a ^ {x}b)" for x in BAG)
    close = f"10 * abs(za - zb) <= greatest(za, zb) and (least(za, zb) <= {SHORT} or bit_count(pa ^ pb) <= {FAR}) and 5 * ({apart} + abs(za - zb)) <= greatest(za, zb)"
    links = _verified(pairs.where(close).select("a", "b"), forms, name)
    release(held)
    return links


def _verified(pairs: DataFrame, forms: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose normal forms are similar."""
    pairs = materialize(pairs, f"{name}-pairs")
    found = _forms(forms, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("form").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("form").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, rows, chars = [], 0, 0
        for batch in batches:
            gathered.append(batch)
            rows += batch.num_rows
            chars += batch.nbytes
            if rows >= GATHERED or chars >= GATHERED * LONG:
                yield _checked(gathered)
                gathered, rows, chars = [], 0, 0
        if gathered:
            yield _checked(gathered)

    links = materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), f"{name}-links")
    release(pairs, found)
    return links


def _checked(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """a, b of the rows (a, b, x, y) with similar x and y."""
    rows = pa.Table.from_batches(batches)
    ok = within(rows.column(2).to_pylist(), rows.column(3).to_pylist())
    return pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[ok], pa.int64()) for c in (0, 1)], names=["a", "b"])


def _placed(rows: DataFrame, components: DataFrame, node: str = "node", as_: str = "component") -> DataFrame:
    c = components.select(F.col("node").alias(node), F.col("component").alias(as_))
    if components.count() <= BROADCAST_NODES:
        c = F.broadcast(c)
    return rows.join(c, node, "left").withColumn(as_, F.coalesce(as_, node))


class Slices:
    """Rows of slices (sig, i, k) of groups, or of one without these columns: what tells whether two of them may be similar."""

    def __init__(self, rows: pa.Table):
        self.of, z, p = (rows.column(c).to_numpy() for c in ("component", "size", "print"))
        self.z, self.p = z.astype(np.int64), p.astype(np.int64).view(_U)
        self.bag = np.stack([rows.column(c).to_numpy().astype(np.int64).view(_U) for c in BAG], axis=1)
        self.starts, self.sigs = np.array([0, rows.num_rows]), None
        if "own" in rows.column_names:
            self.sig, self.i, self.k, self.own = (rows.column(c).to_numpy() for c in ("sig", "i", "k", "own"))
            self.starts = np.append(_starts(rows), rows.num_rows)
            lists = rows.column("sigs").combine_chunks()
            self.sigs = np.full((rows.num_rows, GROUPS), np.iinfo(np.int64).max)
            self.sigs[np.arange(GROUPS) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows of one slice that may be similar and are in two components.

        Pairs of one slice are left to that slice by itself, and pairs that share several of their first GROUPS groups to the smallest.
        """
        for low, high in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            a, each = low, max(1, 100_000 // max(1, high - low))
            while a < high:
                x, y = np.arange(a, min(a + each, high))[:, None], np.arange(a, high)
                near = (self.of[x] != self.of[y]) & (x < y)
                if self.sigs is not None and self.i[low] != self.k[low]:
                    near &= self.own[x] != self.own[y]
                longer, shorter = np.maximum(self.z[x], self.z[y]), np.minimum(self.z[x], self.z[y])
                near &= 10 * (longer - shorter) <= longer
                near &= (shorter <= SHORT) | (np.bitwise_count(self.p[x] ^ self.p[y]) <= FAR)
                left, right = np.nonzero(near)
                left, right = left + a, right + a
                z = np.maximum(self.z[left], self.z[right])
                steps = np.bitwise_count(self.bag[left] ^ self.bag[right]).sum(axis=1, dtype=np.int64)
                ok = 5 * (steps + np.abs(self.z[left] - self.z[right])) <= z
                left, right = left[ok], right[ok]
                if self.sigs is not None and len(left):
                    sooner = np.where(self.sigs[left] < self.sig[low], self.sigs[left], -1)[:, :, None] == np.where(self.sigs[right] < self.sig[low], self.sigs[right], -2)[:, None, :]
                    ok = ~sooner.any(axis=(1, 2))
                    left, right = left[ok], right[ok]
                if len(left):
                    yield left, right
                a += each


def _starts(rows: pa.Table, by: tuple[str, ...] = ("sig", "i", "k")) -> np.ndarray:
    new = np.append(True, np.zeros(max(0, rows.num_rows - 1), bool))[: rows.num_rows]
    for c in by:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _whole_slices(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("sig", "i", "k"), least: int = GATHERED) -> Iterator[pa.Table]:
    """Rows sorted by the columns `by`, some whole slices at a time."""
    held, rows, enough = [], 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held)
            last = int(_starts(table, by)[-1])
            if last:
                yield table.slice(0, last)
            held, rows = table.slice(last).to_batches(), rows - last
            enough = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _between(rows: pa.Table) -> pa.Table:
    """Pairs a < b of nodes of one slice of a group that may be similar and are in two components."""
    rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy())))
    node, none = rows.column("node").to_numpy(), np.empty(0, np.int64)
    found = [(none, none), *((node[x], node[y]) for x, y in Slices(rows).close())]
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


MET = "a long, b long, sig long, node long, size int, print long, " + ", ".join(f"{c} long" for c in BAG)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members sorted by (sig, h): pairs a < b of different components that may be similar, and the members of larger groups of several components.

    Small groups give all such pairs, larger ones those with their first node.
    """
    names = ["sig", "node", "size", "print", *BAG]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *(pa.int64() for _ in range(1 + len(BAG)))]
    for rows in _whole_slices(batches, ("sig",), 8 * GATHERED):
        start = _starts(rows, ("sig",))
        size = np.diff(np.append(start, rows.num_rows))
        of, node = rows.column("component").to_numpy(), rows.column("node").to_numpy()
        several = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
        group = np.repeat(np.arange(len(start)), size)
        hot = np.flatnonzero((several & (size > SMALL))[group])
        few = np.flatnonzero((several & (size <= SMALL))[group])
        left, right = [start[group[hot]]], [hot]
        for k in range(1, SMALL):
            both = few[: max(0, len(few) - k)], few[k:]
            same = group[both[0]] == group[both[1]]
            left.append(both[0][same])
            right.append(both[1][same])
        x, y = np.concatenate(left), np.concatenate(right)
        apart = of[x] != of[y]
        x, y = x[apart], y[apart]
        z, p = rows.column("size").to_numpy().astype(np.int64), rows.column("print").to_numpy()
        longer, shorter = np.maximum(z[x], z[y]), np.minimum(z[x], z[y])
        ok = (10 * (longer - shorter) <= longer) & ((shorter <= SHORT) | (np.bitwise_count((p[x] ^ p[y]).view(_U)) <= FAR))
        x, y, longer, shorter = x[ok], y[ok], longer[ok], shorter[ok]
        steps = longer - shorter
        for c in BAG:
            bag = rows.column(c).to_numpy()
            steps += np.bitwise_count((bag[x] ^ bag[y]).view(_U))
        ok = 5 * steps <= longer
        a, b = node[x[ok]], node[y[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs.T.copy()), *(pa.nulls(len(pairs), k) for k in kinds[2:])], names=["a", "b", *names])
        if len(hot):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(hot), k) for k in kinds[:2]), *(pa.array(rows.column(c).to_numpy()[hot], k) for c, k in zip(names, kinds[2:], strict=True))], names=["a", "b", *names])


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by slices, that may be similar to another one of their slice."""
    for rows in _whole_slices(batches):
        some = np.zeros(rows.num_rows, bool)
        for x, y in Slices(rows).close():
            some[x] = some[y] = True
        yield from rows.filter(pa.array(some)).to_batches()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, sure, of rows sorted by slices: links that join components; pairs with a line of over LONG characters, whose form doesn't come along, are not sure."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int, bool]] = []

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def settle(pairs: list[tuple[int, int, int, int, str, str]]) -> None:
        pairs = [p for p in pairs if root(p[2]) != root(p[3])]
        for k in np.flatnonzero(within([p[4] for p in pairs], [p[5] for p in pairs])).tolist():
            x, y = root(pairs[k][2]), root(pairs[k][3])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((*pairs[k][:2], True))

    def made() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "sure"])
        out.clear()
        return done

    pairs = []
    for rows in _whole_slices(batches):
        node, of, forms = rows.column("node").to_pylist(), rows.column("component").to_pylist(), rows.column("form").to_pylist()
        for left, right in Slices(rows).close():
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                if forms[i] is None or forms[j] is None:
                    out.append((node[i], node[j], False))
                else:
                    pairs.append((node[i], node[j], of[i], of[j], forms[i], forms[j]))
            if len(pairs) >= GATHERED:
                settle(pairs)
                pairs = []
            if len(out) >= GATHERED:
                yield made()
        if len(parent) > SEEN:
            parent.clear()  # links that join what is joined already do no harm
    settle(pairs)
    yield made()


def _left_apart(members: DataFrame, components: DataFrame, forms: DataFrame) -> DataFrame:
    """a, b, sure: links between components, of nodes of hot groups (sig, node, size, print, bag); what isn't sure is to be verified."""
    placed = _placed(members, components)
    apart = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / SLICE).alias("slices")).where("low <> high")
    opened = materialize(placed.join(apart.select("sig", "slices"), "sig"), "opened")
    nodes = opened.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, GROUPS).alias("sigs"))
    rows = opened.join(nodes, "node").withColumn("own", F.expr("pmod(xxhash64(node), slices)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, slices - 1)"))).withColumns({"i": F.least("own", "other"), "k": F.greatest("own", "other")})
    rows = rows.select("sig", "i", "k", "own", "sigs", "node", "component", "print", "size", *BAG)
    sliced = lambda rows: rows.repartition("sig", "i", "k").sortWithinPartitions("sig", "i", "k")
    some = materialize(sliced(rows).mapInArrow(_not_alone, rows.schema), "some")
    found = _forms(forms, some.where(f"size <= {LONG}").select("node").distinct())
    out = materialize(sliced(some.join(found, "node", "left")).mapInArrow(_joined, "a long, b long, sure boolean"), "apart")
    release(opened, some, found)
    return out


def groups_of(nodes: DataFrame) -> DataFrame:
    """node, component of the nodes that are linked to another one; nodes: node, form, print, size, blocks, bag, a node more than once or not."""
    prints = materialize(nodes.select("node", "print", "size", *BAG).dropDuplicates(["node"]), "prints")
    forms = nodes.select("node", "form")
    size = nodes.agg(F.coalesce(F.sum(F.octet_length("blocks")), F.lit(0))).first()[0] / 8
    found = materialize(met_in_buckets(nodes.select("node", "blocks"), _blocks_of, max(64, math.ceil(size / BUCKET))), "found")
    first = found.where(f"kind = {FIRST}").groupBy(F.col("node").alias("b")).agg(F.min("other").alias("a"))
    links = _similar(first.select("a", "b"), prints, forms, "first")
    components = materialize(connected_components(links), "components")
    members = found.where(f"kind = {MEMBER}").select("node", F.col("other").alias("sig")).repartition("node").distinct().join(prints, "node")
    written = [found]
    for k in range(ROUNDS):
        placed = _placed(members, components).withColumn("h", F.xxhash64("node", F.lit(k)))
        met = materialize(placed.repartition("sig").sortWithinPartitions("sig", "h", "node").mapInArrow(_met, MET), "members")
        release(*written)
        new = _verified(met.where("a is not null").select("a", "b").distinct(), forms, "near")
        links = links.unionAll(new)
        components = materialize(connected_components(links), "components")
        members, written = met.where("a is null").select("sig", "node", "size", "print", *BAG), [met]
        if k and RARE * new.count() <= members.count():
            break
    apart = _left_apart(members, components, forms)
    release(*written)
    links = links.unionAll(apart.where("sure").select("a", "b"))
    if not (unsure := apart.where("not sure").select("a", "b").distinct()).isEmpty():
        links = links.unionAll(_similar(unsure, prints, forms, "apart"))
    components = materialize(connected_components(links), "components")
    release(prints, apart)
    return components


def dedup(docs: DataFrame) -> DataFrame:
    """docs with its text changed, and n_lines (with a word), n_removed."""
    prepare(docs.sparkSession)
    scanned = materialize(_scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "lines")
    components = groups_of(scanned.where("doc_id is null").select("node", "form", "print", "size", "blocks", *BAG))
    seen = materialize(scanned.where("doc_id is not null").select("node", "doc_id", "line"), "seen")
    release(scanned)
    nodes = seen.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    placed = materialize(_placed(nodes, components), "placed")
    kept = placed.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").select("component", "keep")
    several = materialize(placed.select("node", "component").join(kept, "component").select("node", "keep"), "several")
    gone = F.when((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line")), F.col("line").cast("int"))
    release(placed)
    by_doc = seen.join(several, "node", "left").groupBy(F.col("doc_id").alias("__fs_id")).agg(F.count_distinct("line").cast("int").alias("__fs_lines"), F.collect_set(gone).alias("__fs_gone"))

    @F.pandas_udf("string")
    def without(texts, lines):
        import pandas as pd

        return pd.Series([None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, map(set, lines), strict=True)], dtype=object)

    out = docs.join(by_doc, docs["doc_id"].cast("long") == F.col("__fs_id"), "left")
    some = F.size("__fs_gone") > 0  # only these texts go to Python
    out = out.withColumn("__fs_text", without(F.when(some, F.col("text")), F.when(some, F.col("__fs_gone")).otherwise(F.array().cast("array<int>"))))
    text = F.when(some, F.col("__fs_text")).otherwise(F.col("text"))
    extra = [(F.coalesce("__fs_lines", F.lit(0)), "n_lines"), (F.when(some, F.size("__fs_gone")).otherwise(0), "n_removed")]
    return out.select(*((text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns), *(e.alias(n if n not in docs.columns else f"__fs_{n}") for e, n in extra))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
