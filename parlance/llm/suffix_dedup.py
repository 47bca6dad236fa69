"""Exact byte-substring dedup: suffix arrays and threshold-bounded interval expansion.

Which texts can share a string of 400 bytes is found by anchors (of a string's 32-byte
grams the one of least hash), and equal contexts of an anchor settle each other. The
contexts that differ meet by the core that their windows share; those of a bucket become one text, with its
suffix array and Burrows-Wheeler transform. Breadth-first, every interval of suffixes that
share a prefix is extended to the left by each byte that precedes one of them; the
end of a new interval is a place whose longest common prefix is the present
length. Lengths come in increasing order, and the search stops at 400: places without a
value then stand between suffixes that share 400 bytes or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import exchange
from parlance.llm.common import Texts, mix, powers

LENGTH = 400
GRAM = 32
#: Windows of an anchor are taken in blocks of so many starts; windows of a block share a core.
BLOCK = 64
CORE = LENGTH - BLOCK + 1
#: A core with more contexts than this is compared window by window, by hash, which spreads a hot core over all tasks.
MOST_CONTEXTS = 256
ASK_WINDOWS, REPEATED_ASK_WINDOWS = 4, 5
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
# the second hash, which verifies the first
_CHECK_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64))
_CHECK_BASE = 0xD1342543DE82EF95


def _sums(data: np.ndarray, byte: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[data] * powers(base, len(data)), dtype=np.uint64)])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    top = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    top[: len(x)] = x
    grid = top.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def find(t: Texts) -> exchange.Entries:
    """Blocks of windows by their anchor (the leftmost 32-byte gram of least hash inside); the core that they share is the entry's key."""
    n = len(t.data)
    lens = np.diff(t.offsets)
    count = np.maximum(lens - LENGTH + 1, 0)
    total = int(count.sum())
    if not total:
        return exchange.Entries.none()
    sums = _sums(t.data, _BYTE, _BASE)
    back = powers(pow(_BASE, -1, 1 << 64), n + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    bits = np.uint64(max(n - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    least = _sliding_min(key, LENGTH - GRAM + 1) & low  # windows over two texts are dropped next
    wdoc = np.repeat(np.arange(len(lens)), count)
    p = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + t.offsets[:-1][wdoc]
    at = least[p].astype(np.int64)
    block = (at - p) // BLOCK
    new = np.ones(total, bool)
    new[1:] = (at[1:] != at[:-1]) | (wdoc[1:] != wdoc[:-1]) | (block[1:] != block[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], total) - 1
    lo, hi = p[head], p[tail]
    core = at[head] - BLOCK * block[head]
    anchor = mix((sums[core + CORE] - sums[core]) * back[core] + block[head].astype(np.uint64))
    ctx = mix((sums[hi + LENGTH] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ mix(anchor + (at[head] - lo).astype(np.uint64))
    sums = _sums(t.data, _CHECK_BYTE, _CHECK_BASE)
    check = mix((sums[hi + LENGTH] - sums[lo]) * powers(pow(_CHECK_BASE, -1, 1 << 64), n + 1)[lo])
    doc = wdoc[head]
    return exchange.Entries(doc, lo - t.offsets[:-1][doc], hi - t.offsets[:-1][doc], anchor, ctx, check)


def settle(id, at, anchor, ctx, check, flag, hot):
    """Entries in order of anchor, context, id and place: a context of two places repeats as a whole; one of each context is open if an anchor has several."""
    g, c = exchange._groups(anchor), exchange._groups(anchor, ctx, check)
    cs = np.flatnonzero(c)
    of = np.cumsum(c) - 1
    places = np.add.reduceat(np.where(flag == exchange.FIRST, 2, 1), cs)[of]
    contexts = np.add.reduceat(c.astype(np.int64), np.flatnonzero(g))[np.cumsum(g) - 1]
    several, hot = hot | (contexts > 1), hot | (contexts > MOST_CONTEXTS)
    # the one to ask is the first that its batch holds as its first
    own = flag != exchange.LATER
    rank = np.cumsum(own) - (np.cumsum(own)[cs] - own[cs])[of]
    speaker = own & (rank == 1)
    code = np.where(places > 1, np.where(several & speaker, np.where(hot, REPEATED_ASK_WINDOWS, exchange.REPEATED_ASK), exchange.REPEATED), np.where(hot, ASK_WINDOWS, np.where(several, exchange.ASK, 0)))
    return code.astype(np.uint8)


def ask(t: Texts, e: exchange.Entries, at: np.ndarray, ids: np.ndarray, version: np.ndarray, code: np.ndarray):
    """The open contexts themselves (len over 0), and the windows of hot cores by hash (len 0), of which equal ones settle each other here."""
    wide = np.isin(code[at], (ASK_WINDOWS, REPEATED_ASK_WINDOWS))
    known = np.zeros((0, 2), np.int64)
    w = at[wide]
    parts = []
    if len(w):
        count = e.hi[w] - e.lo[w] + 1
        doc = np.repeat(e.doc[w], count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(e.lo[w], count)
        n = len(t.data)
        a = t.offsets[:-1][doc] + place
        h, check = (mix((x[a + LENGTH] - x[a]) * powers(pow(base, -1, 1 << 64), n)[a]) for base, x in ((_BASE, _sums(t.data, _BYTE, _BASE)), (_CHECK_BASE, _sums(t.data, _CHECK_BYTE, _CHECK_BASE))))
        order = np.lexsort((place, doc, check, h))
        h, check, doc, place = h[order], check[order], doc[order], place[order]
        new = exchange._groups(h, check)
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        many = np.repeat(size, size) > 1
        known = np.stack([doc[many], place[many]], axis=1)
        parts.append((mix(h[new]), {"id": ids[doc[new]], "at": place[new] | (version[doc[new]] << 40), "hash": h[new], "check": check[new], "len": np.zeros(int(new.sum()), np.int32), "own": many[new].astype(np.int32)}))
    at = at[~wide]
    doc, lo, hi = e.doc[at], e.lo[at], e.hi[at]
    length = hi - lo + LENGTH
    data = [t.data[x : x + m] for x, m in zip((t.offsets[:-1][doc] + lo).tolist(), length.tolist())]
    parts.append((mix(e.anchor[at]), {"id": ids[doc], "at": lo | (version[doc] << 40), "hash": e.anchor[at], "check": np.zeros(len(at), np.uint64), "len": length.astype(np.int32), "own": (code[at] == exchange.REPEATED_ASK).astype(np.int32)}))
    cols = {c: np.concatenate([x[c] for _, x in parts]) for c in parts[0][1]} | {"data": np.concatenate([*data, np.zeros(0, np.uint8)])}
    bucket = (np.concatenate([k for k, _ in parts]) >> np.uint64(1)).astype(np.int64)
    every = np.concatenate([w, at])
    return bucket, cols, known, e.doc[every[np.isin(code[every], (exchange.ASK, ASK_WINDOWS))]]


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` symbols at least, and their ranks (equal ones by place).

    s holds non-negative symbols. Ranks of triples triple the length compared; suffixes that stand alone are left out.
    """
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    rank = np.searchsorted(sorted_rank, sorted_rank, side="left")[np.argsort(order, kind="stable")]  # rank: first place of the group
    h = 1
    bits = np.uint64(n.bit_length() + 1)
    while h < depth:
        group_size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(group_size[rank[order]] > 1)  # places in order, whose group isn't settled
        if not len(active):
            break
        own = order[active]
        second = np.zeros(len(own), np.uint64)
        third = np.zeros(len(own), np.uint64)
        b, c = own + h, own + 2 * h
        ok = b < n
        second[ok] = rank[b[ok]].astype(np.uint64) + np.uint64(1)
        ok = c < n
        third[ok] = rank[c[ok]].astype(np.uint64) + np.uint64(1)
        first = rank[own].astype(np.uint64)
        if 3 * int(bits) <= 64:
            key = (first << (bits + bits)) | (second << bits) | third
            turn = np.argsort(key, kind="stable")
            step = 3
        else:
            turn = np.lexsort((third, second, first))
            step = 3
        own, first, second, third = own[turn], first[turn], second[turn], third[turn]
        order[active] = own
        new = exchange._groups(first, second, third)
        head = active[np.flatnonzero(new)]
        rank[own] = head[np.cumsum(new) - 1]
        h *= step
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefix_gaps(s: np.ndarray, order: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Whether suffix i of the order shares fewer than `least` symbols with suffix i - 1."""
    n = len(s)
    set_ = np.zeros(n + 1, bool)
    set_[0] = set_[n] = True
    # the first symbol of an extended suffix is the transform's symbol of the suffix it extends
    first_symbol = s[order].astype(np.int32)
    image = np.where(order > 0, place[order - 1], -1).astype(np.int32)  # where the suffix goes when extended to the left
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    last = np.int32(place[n - 1])  # the last symbol's suffix extends the empty one, which the order leaves out
    for length in range(least):
        size = hi - lo
        alone = size == 1
        # an interval of one suffix has one extension
        left = image[lo[alone]]
        left = left[left >= 0]
        right = left + 1
        lo, hi, size = lo[~alone], hi[~alone], size[~alone]
        if len(lo):
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size, dtype=np.int64) - size - lo, size)
            to = image[at]
            key = np.repeat(np.arange(len(lo), dtype=np.int64), size) * (n + 1) + to
            key = np.sort(key[to >= 0])
            to = key % (n + 1)
            new = exchange._groups(key // (n + 1), first_symbol[to]) if len(key) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            left = np.concatenate([left, to[heads].astype(np.int32)])
            right = np.concatenate([right, to[np.append(heads[1:], len(to)) - 1].astype(np.int32) + 1]) if len(heads) else right
        if length == 0:
            left, right = np.append(left, last), np.append(right, last + np.int32(1))
        # the end of an extension is the end of no other one of this length, so that none comes twice
        fresh = ~set_[right]
        lo, hi = left[fresh], right[fresh]
        if not len(lo):
            break
        set_[hi] = True
    return set_[:n]


def repeated_starts(texts: list[np.ndarray], least: int = LENGTH) -> list[np.ndarray]:
    """For each text, whether the string of `least` bytes at each of its starts stands elsewhere in the texts."""
    n = len(texts)
    length = np.array([len(x) for x in texts])
    ends = np.cumsum(length + 1)
    s = np.zeros(int(ends[-1]), np.int64)
    for x, e in zip(texts, ends.tolist()):
        s[e - 1 - len(x) : e - 1] = x.astype(np.int64) + n
    s[ends - 1] = np.arange(n)  # every text ends in a symbol of its own
    order, place = suffix_array(s, least + 1)
    gap = common_prefix_gaps(s, order, place, least)
    group = np.cumsum(gap) - 1
    size = np.bincount(group)
    many = np.zeros(len(s), bool)
    many[order] = size[group] > 1
    return [many[e - 1 - m : e - 1 - m + max(m - least + 1, 0)] for e, m in zip(ends.tolist(), length.tolist())]


#: Bytes of contexts that one suffix array takes, but for the contexts of one core, which stay together.
BLOCK_BYTES = 256 << 10


def resolve(q: dict[str, np.ndarray]):
    """Starts of contexts that repeat in another context of the bucket, and windows that stand at two places."""
    single = np.flatnonzero(q["len"] == 0)
    order = single[np.lexsort((q["check"][single], q["hash"][single]))]
    new = exchange._groups(q["hash"][order], q["check"][order]) if len(order) else np.zeros(0, bool)
    places_of = np.add.reduceat(1 + q["own"][order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    hit = order[places_of > 1]
    ids, places, counts = q["id"][hit].tolist(), q["at"][hit].tolist(), [1] * len(hit)
    ends = np.cumsum(q["len"], dtype=np.int64)
    at = ends - q["len"]
    many = np.flatnonzero(q["len"] > 0)
    order = many[np.argsort(q["hash"][many], kind="stable")]
    for own in _blocks(order, q["hash"], q["len"]):
        texts = [q["data"][at[i] : ends[i]] for i in own.tolist()]
        for i, hit in zip(own.tolist(), repeated_starts(texts)):
            if q["own"][i] or not hit.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            ids += [q["id"][i]] * (len(edge) // 2)
            places += (q["at"][i] + edge[::2]).tolist()
            counts += (edge[1::2] - edge[::2]).tolist()
    return np.array(ids, np.int64), np.array(places, np.int64), np.array(counts, np.int32)


def _blocks(order: np.ndarray, anchor: np.ndarray, length: np.ndarray):
    """Runs of whole anchors of about BLOCK_BYTES; an anchor's contexts stay together."""
    a = anchor[order]
    heads = np.flatnonzero(exchange._groups(a)) if len(a) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(length[order], dtype=np.int64)])
    start = 0
    for k, h in enumerate(heads.tolist()):
        end = int(heads[k + 1]) if k + 1 < len(heads) else len(a)
        if end == len(a) or total[int(heads[k + 2]) if k + 2 < len(heads) else len(a)] - total[start] > BLOCK_BYTES:
            yield order[start:end]
            start = end


def finish(raw: bytes, ranges: list | None, texts: bool) -> tuple:
    if not ranges:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), None
    spans = exchange.merged(ranges, LENGTH)
    kept, upto = [], 0
    for a, b in spans:
        kept.append(raw[upto:a])
        upto = b
    out = b"".join([*kept, raw[upto:]])
    return len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(out).hexdigest(), out if texts else None


OPERATOR = exchange.Repeats(find, settle, ask, resolve, finish, same_place_counts=True, repeated=(exchange.REPEATED, exchange.REPEATED_ASK, REPEATED_ASK_WINDOWS))


def report(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with `texts`, the text that is left too.

    A byte goes if a string of 400 bytes that covers it starts at any other place of
    any row, rows that share a doc_id included. Strings are judged on the input. Null
    and empty texts have no bytes. A cut may leave bytes that are no valid UTF-8.
    """
    out = exchange.deduplicated(docs, OPERATOR, texts)
    return out.select("doc_id", F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"), *(["text"] if texts else []))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text (bytes that are no valid UTF-8 then are replaced); other columns stay."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    return exchange.deduplicated(docs, OPERATOR, keep=keep).select(*docs.columns)
