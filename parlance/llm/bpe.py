"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Code points become classes by array
lookup; a class and a little lookahead become one of 16 symbols; each symbol is a
function on the eight states of a small automaton. Composition of such functions
is associative, so that a blocked scan (compose within blocks, scan the blocks,
replay) yields the state before every character, and from it every boundary. The
slices between boundaries go through a cache of pair merges. Token byte offsets
are kept, so that ids decode to bytes and to their places in the text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Texts, pieces, texts_of

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
#: The code points of Unicode's White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Symbols: letter, number, other, apostrophe of a two- or three-character contraction,
#: space that joins what follows, other blank before a non-blank, blank inside or at the end of a run.
L, N, O, Q2, Q3, JOIN, ALONE, RUN = range(8)  # noqa: E741
#: States, by what precedes: nothing that can go on, a run of letters, numbers or others, a joining
#: space, a blank run, a contraction that lacks one or two characters.
FRESH, IN_L, IN_N, IN_O, JOINED, IN_RUN, LACKS1, LACKS2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state, symbol] and breaks[state, symbol]: whether a token starts at the symbol."""
    own = {L: IN_L, N: IN_N, O: IN_O, Q2: LACKS1, Q3: LACKS2, JOIN: JOINED, ALONE: FRESH, RUN: IN_RUN}
    kind = {L: IN_L, N: IN_N, O: IN_O, Q2: IN_O, Q3: IN_O}
    step, breaks = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for state in range(8):
        for sym in range(8):
            to, new = own[sym], True
            if state in (LACKS1, LACKS2):
                to, new = (FRESH if state == LACKS1 else LACKS1), False
            elif state == JOINED or state in (IN_L, IN_N, IN_O) and kind.get(sym) == state:
                if sym in kind and (state != IN_O or kind[sym] == IN_O):
                    to, new = kind[sym], False
            elif state == IN_RUN and sym == RUN:
                new = False
            step[state, sym], breaks[state, sym] = to, new
    return step, breaks


def _monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All functions that the 16 symbols generate (8 to 15 start a text), and the table of their compositions."""
    made = [tuple(step[:, s].tolist()) for s in range(8)] + [(int(step[FRESH, s]),) * 8 for s in range(8)]
    # index by symbol first, then by closure; equal functions may appear twice among the symbols
    index = {f: i for i, f in reversed(list(enumerate(made)))}
    todo = list(made)
    while todo:
        f = todo.pop()
        for g in made[:16]:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(made)
                made.append(h)
                todo.append(h)
    table = np.array(made, np.uint8)
    then = np.array([[index[tuple(g[x] for x in f)] for g in made] for f in made], np.uint16)
    return table, then


class PreTokenizer:
    """Boundaries of the pattern's matches, for a run of texts at once."""

    BLOCK = 256

    def __init__(self) -> None:
        self.step, self.breaks = _automaton()
        self.functions, self.then = _monoid(self.step)
        self.classes, self.known = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        if not self.known[points].all():
            for p in np.unique(points[~self.known[points]]).tolist():
                major = unicodedata.category(chr(p))[0]
                self.classes[p] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
                self.known[p] = True
            self.classes[WHITE], self.known[WHITE], self.classes[32] = BLANK, True, SPACE
        return self.classes[points]

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: whether a text starts here."""
        n = len(points)
        cls = self._classes(points)
        symbol = cls.copy()  # letter, number and other are alike in both
        ends = np.append(first[1:], True)
        blank = cls >= SPACE
        solid_next = np.append(~blank[1:], False) & ~ends
        symbol[blank] = RUN
        at = blank & solid_next
        symbol[at] = np.where(cls[at] == SPACE, JOIN, ALONE)
        quote = np.flatnonzero(points == 0x27)
        if len(quote):
            wide = np.concatenate([points, np.zeros(2, points.dtype)])
            open1 = ~ends[quote]
            open2 = open1 & ~np.append(ends, True)[quote + 1]
            a, b = wide[quote + 1], wide[quote + 2]
            two = open1 & np.isin(a, [ord(c) for c in "stmd"])
            three = open2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
            symbol[quote[two]], symbol[quote[three]] = Q2, Q3
        assert n == len(symbol)
        return symbol + np.uint8(8) * first

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a token starts at each code point."""
        n, width = len(points), self.BLOCK
        if not n:
            return np.zeros(0, bool)
        symbol = self.symbols(points, first)
        blocks = -(-n // width)
        grid = np.zeros(blocks * width, np.uint16)
        grid[:n] = symbol
        grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
        # compose within each block, all blocks at once
        m, then = len(self.functions), self.then.ravel()
        whole = grid[0].astype(np.int64)
        for row in grid[1:]:
            whole = then[whole * m + row].astype(np.int64)
        # scan over the blocks, by doubling
        reach = 1
        while reach < blocks:
            whole[reach:] = then[whole[:-reach] * m + whole[reach:]]
            reach *= 2
        state = np.empty(blocks, np.int64)
        state[0], state[1:] = FRESH, self.functions[whole[:-1], FRESH]
        # replay each block from its state
        step = np.concatenate([self.step, np.broadcast_to(self.step[FRESH], (8, 8))], axis=1).astype(np.int64).ravel()
        breaks = np.concatenate([self.breaks, np.ones((8, 8), bool)], axis=1).ravel()
        out = np.empty((width, blocks), bool)
        for t, row in enumerate(grid):
            key = state * 16 + row
            out[t] = breaks[key]
            state = step[key]
        return np.ascontiguousarray(out.T).ravel()[:n]

    def slices(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of all slices of the texts (the last entry is the end), and the first slice of each text."""
        if not len(t.data):
            return np.zeros(1, np.int64), np.zeros(len(t) + 1, np.int64)
        points = np.frombuffer(t.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((t.data & 0xC0) != 0x80)
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(lead, t.offsets)] = True
        at = lead[self.starts(points, first[:-1])]
        return np.append(at, len(t.data)), np.searchsorted(at, t.offsets)


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """A ranks file: a line has a token in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder over ranks; ids of a slice are merged once and cached."""

    #: Entries of the cache before it starts anew; bounds the memory, not the result.
    CACHE = 400_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.pre = ranks, PreTokenizer()
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.token[i] = token
        self.cache: dict[bytes, tuple[int, ...]] = {}
        # all tokens' bytes as one array, for decoding many at once
        self.size = np.array([len(x) for x in self.token], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        while pair and (low := min(pair)) < 1 << 40:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for long slices, by a heap over linked parts: n log n rather than n * n."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, t: Texts) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """Ids of each slice, byte offsets of the slices, and the first slice of each text."""
        bounds, first = self.pre.slices(t)
        data, cut = t.data.tobytes(), bounds.tolist()
        cache = self.cache
        if len(cache) > self.CACHE:
            cache.clear()
        out = []
        for a, b in zip(cut, cut[1:]):
            piece = data[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = cache[piece] = self.merge(piece)
            out.append(ids)
        return out, bounds, first

    def starts(self, ids: np.ndarray, groups: list[tuple[int, ...]], bounds: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the batch: its slice's, and its place in the slice."""
        per_slice = np.fromiter(map(len, groups), np.int64, len(groups))
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        head = np.cumsum(per_slice) - per_slice  # the first token of each slice
        return upto[:-1] + np.repeat(bounds[:-1] - upto[head], per_slice)

    def decode(self, ids: np.ndarray, starts: np.ndarray | None = None) -> bytes:
        """The bytes that the ids stand for, each token put at its retained offset; without offsets, one behind the other."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        size = self.size[ids]
        one_behind = np.cumsum(size) - size
        starts = one_behind if starts is None else np.asarray(starts, np.int64)
        out = np.zeros(int((starts + size).max()), np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(one_behind, size)
        out[np.repeat(starts, size) + step] = self.bytes[np.repeat(self.place[ids], size) + step]
        return out.tobytes()


def _tokens(bpe: ByteBPE, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts of a batch, the byte offset of each in the batch, and the first token of each text (n + 1 entries)."""
    groups, bounds, first = bpe.encode(t)
    ids = np.fromiter(chain.from_iterable(groups), np.int64)
    per_slice = np.fromiter(map(len, groups), np.int64, len(groups))
    return ids, bpe.starts(ids, groups, bounds), np.concatenate([[0], np.cumsum(per_slice)])[first]


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.astype(np.int32)))


ENCODED = "ids array<int>, starts array<int>"


def _vocabulary(df: DataFrame, ranks_path: str) -> object:
    """The ranks file as a broadcast; it is checked to be small."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a ranks file over 64 MB isn't broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, ids and the byte offset of each token in its text. A null text has no ids."""
    raw = _vocabulary(docs, ranks_path)
    keep = keep or ["doc_id"]
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(load_ranks(raw.value))
        for b in pieces(batches, "__text"):
            t = texts_of(b.column(len(keep)))
            ids, starts, first = _tokens(bpe, t)
            own = starts - np.repeat(t.offsets[:-1], np.diff(first))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), _lists(ids, first), _lists(own, first)], names=[*keep, "ids", "starts"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{types}, {ENCODED}")


def decode(encoded: DataFrame, ranks_path: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns and the bytes that the ids stand for, by the offsets in `starts` if there are any. Null ids give empty bytes."""
    raw = _vocabulary(encoded, ranks_path)
    keep, placed = keep or ["doc_id"], "starts" in encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(load_ranks(raw.value))
        for b in batches:
            ids = b.column(len(keep)).to_pylist()
            at = b.column(len(keep) + 1).to_pylist() if placed else [None] * len(ids)
            made = [bpe.decode(x or [], y if x else None) for x, y in zip(ids, at)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(made, pa.binary())], names=[*keep, "decoded"])

    types = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids", *(["starts"] if placed else [])).mapInArrow(run, f"{types}, decoded binary")


def digests(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded in one pass; on demand ids and starts too.

    A batch's tokens are decoded together, each put at the offset that encoding retained.
    Null and empty texts have no tokens; repeated rows give repeated rows; a null doc_id stays null.
    """
    raw = _vocabulary(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(load_ranks(raw.value))
        digit = list(map(str, range(len(bpe.token))))
        for b in pieces(batches):
            t = texts_of(b.column(1))
            ids, starts, first = _tokens(bpe, t)
            decoded, said, cut, ends = bpe.decode(ids, starts), ids.tolist(), first.tolist(), t.offsets.tolist()
            ids_sha = [hashlib.sha256(" ".join([digit[i] for i in said[x:y]]).encode()).hexdigest() for x, y in zip(cut, cut[1:])]
            text_sha = [hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(ends, ends[1:])]
            cols = [b.column(0), pa.array(np.diff(first)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                cols += [_lists(ids, first), _lists(starts - np.repeat(t.offsets[:-1], np.diff(first)), first)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "starts"][: 6 if with_ids else 4]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + f", {ENCODED}" * with_ids)
