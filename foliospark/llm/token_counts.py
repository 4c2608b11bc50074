"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers in sequence replace the tokenizer library:

* The *splitter* reads code-point classes (with a bounded look-ahead folded into the symbol) and marks where a
  pre-token starts. Its transition monoid, that is the set of all state maps that any text induces, is finite and small; it is
  enumerated once, with a multiplication table. Texts of a batch are laid end to end and cut into chunks of equal
  length; the chunks' state maps are computed side by side and composed by a parallel prefix scan, which gives the
  state before every chunk and so at every code point.
* The *merger* reads the bytes of a pre-token. A state holds, for each position from which a vocabulary entry may still
  continue, the last token of the encoding up to there and its token count relative to now. A transition on a byte
  carries the change of the token count. States are made when first reached and kept up to a bound.

The merger relies on a property of byte-pair encoding: a sequence of tokens is the encoding of its bytes just when each
adjacent pair is the encoding of its own bytes. So the last token of an encoding is the only vocabulary suffix that fits
the last token of the encoding before it.

Nulls and empty texts have 0 bytes and 0 tokens. Special strings inside a text count as the one token that the
library's default makes of them. Repeated rows give repeated results; other columns pass by and may have any name.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm._common import prepare, table

# ---------------------------------------------------------------- the splitter

#: Symbols: letter, number, other, space and other white space before a non-space, either before white space or the end,
#: apostrophe that may open a contraction of one or two letters, text boundary.
LET, NUM, OTH, SP1, WS1, GAP, AP1, AP2, END = range(9)
#: States: fresh, after an attached space, in white space, in letters, numbers, others, one or two letters of a contraction left.
FRESH, ATT, WHITE, INL, INN, INO, LEFT1, LEFT2 = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by state and symbol."""
    to, starts = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    to[:, LET], to[:, NUM], to[:, OTH], to[:, SP1], to[:, WS1], to[:, GAP], to[:, END] = INL, INN, INO, ATT, FRESH, WHITE, FRESH
    to[:, AP1], to[:, AP2] = LEFT1, LEFT2
    for state, symbol in ((INL, LET), (ATT, LET), (INN, NUM), (ATT, NUM), (INO, OTH), (ATT, OTH), (WHITE, GAP)):
        starts[state, symbol] = False
    for state in (INO, ATT):  # inside a run of others, or behind its space, an apostrophe opens nothing
        for symbol in (AP1, AP2):
            to[state, symbol], starts[state, symbol] = INO, False
    to[LEFT1, LET], to[LEFT2, LET] = FRESH, LEFT1
    starts[LEFT1, LET] = starts[LEFT2, LET] = False
    return to, starts


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All state maps; the map after one more symbol; the product of two maps (left one first)."""
    maps = {tuple(range(len(to))): 0}
    order = list(maps)
    for m in order:
        for symbol in range(to.shape[1]):
            x = tuple(int(to[s, symbol]) for s in m)
            if x not in maps:
                maps[x] = len(maps)
                order.append(x)
    apply = np.array(order, np.uint8)
    then = np.array([[maps[tuple(int(to[s, y]) for s in m)] for y in range(to.shape[1])] for m in order], np.uint16)
    product = np.array([[maps[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16)
    return apply, then, product


TO, STARTS = _machine()
APPLY, THEN, PRODUCT = _monoid(TO)

_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: np.ndarray | None = None


def code_classes() -> np.ndarray:
    """LET, NUM, OTH, or GAP for white space, for each code point."""
    global _classes
    if _classes is None:
        kind = {"L": LET, "N": NUM}
        _classes = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTH) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        _classes[list(_SPACES)] = GAP
    return _classes


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ends holds the places of text boundaries, each of which takes one code point."""
    kind = code_classes()[codes]
    kind[ends] = GAP  # as seen from before: no non-space follows
    after = np.append(kind[1:], GAP)
    out = kind.copy()
    white = (kind == GAP) & (after != GAP)
    out[white] = np.where(codes[white] == 32, SP1, WS1)
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = pad[quotes + 1], pad[quotes + 2]
        has = lambda at, letters: np.isin(at, [ord(c) for c in letters])
        out[quotes[has(one, "stmd")]] = AP1
        out[quotes[(has(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = AP2
    out[ends] = END
    return out


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive products of state maps from the left, in log2(n) rounds over the whole array."""
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], PRODUCT[maps[:-step], maps[step:]]])
        step *= 2
    return maps


def pretoken_starts(codes: np.ndarray, ends: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Places where a pre-token (or a boundary) starts."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    syms = symbols(codes, ends)
    lanes = -(-n // chunk)
    cut = np.full(lanes * chunk, END, np.uint8)
    cut[:n] = syms
    cut = np.ascontiguousarray(cut.reshape(lanes, chunk).T)  # a row is one place in all chunks
    inside = np.empty((chunk, lanes), np.uint16)  # the map of what stands in the chunk before this place
    m = np.zeros(lanes, np.uint16)
    for i in range(chunk):
        inside[i] = m
        m = THEN[m, cut[i]]
    before = np.zeros(lanes, np.uint8)
    before[1:] = APPLY[prefix_scan(m)[:-1], FRESH]
    state = APPLY[inside, before[None, :]]
    return np.flatnonzero(STARTS[state, cut].T.reshape(-1)[:n])


# ------------------------------------------------------------------ the merger


class Merger:
    """Byte-pair encoding as a deterministic transducer whose transitions carry changes of the token count."""

    LIMIT = 160_000

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.halves = {a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | set(self.halves)
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.whole = {t: self.encode(t) == [t] for t in self.tokens if len(t) > 1}
        self.counts: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [(b"", ((None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.shapes: dict[tuple[bytes, int], tuple] = {}
        self.fits_memo: dict[tuple[bytes, bytes], bool] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """Encoding of a short piece by merging in order of rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: bytes | None, token: bytes) -> bool:
        """Whether `token` can stand behind `last`: undoing merges from the latest on, no pair across the border came first."""
        if last is None:
            return self.whole.get(token, True)
        key = (last, token)
        found = self.fits_memo.get(key)
        if found is None:
            limit, none = 1 << 60, (b"", b"", -1)
            while True:
                if self.rank.get((last, token), limit) < limit:
                    found = False
                    break
                a, b = self.halves.get(last, none), self.halves.get(token, none)
                if a[2] == b[2] == -1:
                    found = True
                    break
                if a[2] > b[2]:
                    limit, last = a[2], a[1]
                else:  # of equal ranks the left one merges first
                    limit, token = b[2] + 1, b[0]
            self.fits_memo[key] = found
        return found

    def _shape(self, window: bytes, byte: int) -> tuple:
        """What a byte does to a window: candidates for the last token, what stays in view, and which places a token may yet start at."""
        grown = window + bytes([byte])
        ends = [(i, grown[i:]) for i in range(len(grown)) if grown[i:] in self.tokens]
        live = [grown[i:] in self.prefixes for i in range(len(grown) + 1)]
        keep = live.index(True)
        shape = self.shapes[window, byte] = (ends, keep, live[keep:], grown[keep:])
        return shape

    def _move(self, number: int, byte: int) -> tuple[int, int]:
        """history[j] has the last token and the relative count of the encoding that ends j bytes after the window's start."""
        window, history = self.states[number]
        ends, keep, live, grown = self.shapes.get((window, byte)) or self._shape(window, byte)
        for start, token in ends:
            last = history[start]
            if last and self.fits(last[0], token):
                count = last[1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        state = (grown, tuple([(x[0], x[1] - count) if alive and x else None for x, alive in zip((*history, (token, count))[keep:], live, strict=True)]))
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[number << 8 | byte] = (n, count)
        return n, count

    def count(self, data: bytes) -> int:
        if len(self.moves) >= self.LIMIT:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            state, change = move if move is not None else self._move(state, byte)
            total += change
        return total

    def piece(self, piece: str) -> int:
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= 2 * self.LIMIT:
                self.counts.clear()
            n = self.count(piece.encode("utf-8", "surrogatepass"))
            if len(piece) < 64:
                self.counts[piece] = n
        return n


def read_vocabulary(path: str) -> dict:
    """Merges as pairs of bytes, in order of rank, and the special strings, of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("only byte-level BPE without a normaliser or added space can be compiled")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    raw = lambda s: bytes(back[c] for c in s)
    pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    special = [x["content"] for x in spec["added_tokens"] if not (x["single_word"] or x["lstrip"] or x["rstrip"])]
    if len(special) != len(spec["added_tokens"]):
        raise ValueError("special tokens that take in white space are not compiled")
    return {"merges": [(raw(a), raw(b)) for a, b in pairs], "special": sorted(special, key=len, reverse=True)}


class Counter:
    """Token counts of a list of texts."""

    def __init__(self, vocabulary: dict):
        import re

        self.special = re.compile("|".join(map(re.escape, vocabulary["special"]))) if vocabulary["special"] else None
        self.merger = Merger(vocabulary["merges"])

    def counts(self, texts: list[str | None], chunk: int = 128) -> np.ndarray:
        pieces: list[str] = []
        extra = np.zeros(len(texts), np.int64)
        owner: list[int] = []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if text and self.special else [text or ""]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        whole = "\n".join(pieces) + "\n"  # each text ends in one boundary
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1) - 1
        starts = pretoken_starts(codes, ends, chunk)
        stops = np.append(starts[1:], len(codes))
        real = ~np.isin(starts, ends, assume_unique=True)
        starts, stops = starts[real], stops[real]
        found = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        known = list(map(self.merger.counts.get, found))
        n = np.array([self.merger.piece(x) if c is None else c for x, c in zip(found, known, strict=True)], np.int64)
        part = np.searchsorted(ends, starts)
        return extra + np.bincount(np.asarray(owner, np.int64)[part], weights=n, minlength=len(texts)).astype(np.int64)[: len(texts)]


_counter: tuple[int, Counter] | None = None


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; see the module for nulls and special strings.

    The vocabulary is read on the driver and sent once to each executor (some MB, whatever the corpus).
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    key = hash((vocabulary_path, sent.id if hasattr(sent, "id") else id(sent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import foliospark.llm.token_counts as home

        if home._counter is None or home._counter[0] != key:
            home._counter = (key, Counter(sent.value))
        counter = home._counter[1]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            first = size = 0
            for i, t in enumerate(texts):  # about a million code points at a time
                size += len(t or "") + 1
                if size >= 1 << 20 or i == len(texts) - 1:
                    n[first : i + 1] = counter.counts(texts[first : i + 1])
                    first, size = i + 1, 0
            n_bytes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
