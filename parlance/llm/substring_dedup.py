"""Substring dedup by recompression.

Texts are parsed in rounds. A round replaces each maximal run of a symbol by one
symbol, then each adjacent pair of a left and a right symbol by one; which symbols
are left is drawn from their names. A name is a hash of what the symbol
replaces, so that it is the same on all executors, and equal substrings get equal
symbols but for a few at either end. With each symbol goes its reach: the words
that decide how it was parsed. A window of 20 words whose words include the reach
of a symbol has that symbol wherever the window occurs, so that the highest such
symbol (by least name among equals) is the window's anchor. Shared anchors reveal the texts that
may share windows; contexts, and where these differ windows, verify them, by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import exchange
from parlance.llm.common import Texts, mix, powers, span_hashes, window_hashes, word_spans

WINDOW = 20
ROUNDS = 2
#: Of the second hash, which verifies the first.
CHECK_SEED, CHECK_BASE = 9, 0xD1342543DE82EF95


class Symbols:
    """Symbols of one level: name, reach [dl, dr) in words of the batch, and text. Reaches beyond the text end outside it."""

    def __init__(self, name, dl, dr, of):
        self.name, self.dl, self.dr, self.of = name, dl, dr, of


def _edges(s: Symbols, first: np.ndarray) -> tuple:
    n = len(s.name)
    prev_ok, next_ok = np.zeros(n, bool), np.zeros(n, bool)
    prev_ok[1:] = s.of[1:] == s.of[:-1]
    next_ok[:-1] = prev_ok[1:]
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[1:], after[:-1] = s.dl[:-1], s.dr[1:]
    return np.where(prev_ok, before, first[:-1][s.of] - 1), np.where(next_ok, after, first[1:][s.of] + 1), next_ok


def runs(s: Symbols, first: np.ndarray) -> Symbols:
    n = len(s.name)
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.of[1:] != s.of[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], n) - 1
    count = (tail - head + 1).astype(np.uint64)
    name = np.where(count > 1, mix(s.name[head] ^ mix(count)), s.name[head])
    before, after, _ = _edges(s, first)
    return Symbols(name, np.minimum(before[head], s.dl[head]), np.maximum(after[tail], s.dr[tail]), s.of[head])


def paired(s: Symbols, first: np.ndarray, salt: int) -> Symbols:
    n = len(s.name)
    right = (mix(s.name ^ np.uint64(salt * 0x9E37 + 1)) & np.uint64(1)).astype(bool)
    before, after, next_ok = _edges(s, first)
    merge = np.zeros(n, bool)
    merge[:-1] = ~right[:-1] & right[1:] & next_ok[:-1]
    second = np.append(False, merge[:-1])
    at = np.flatnonzero(~second)
    nxt = np.minimum(at + 1, n - 1)
    m, r = merge[at], right[at]
    name = np.where(m, mix(s.name[at] * np.uint64(0x9E3779B97F4A7C15) + mix(s.name[nxt])), s.name[at])
    dl = np.where(r, np.minimum(before[at], s.dl[at]), s.dl[at])
    dr = np.where(m, np.maximum(s.dr[nxt], s.dr[at]), np.where(r, s.dr[at], np.maximum(after[at], s.dr[at])))
    return Symbols(name, dl, dr, s.of[at])


class Prefix:
    """Hashes of any run of words."""

    def __init__(self, words: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, n), dtype=np.uint64)])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def find(t: Texts) -> exchange.Entries:
    starts, ends, first = word_spans(t)
    return entries_of(span_hashes(t.data, starts, ends), span_hashes(t.data, starts, ends, seed=CHECK_SEED), first)


def entries_of(words: np.ndarray, checks: np.ndarray, first: np.ndarray) -> exchange.Entries:
    lens = np.diff(first)
    count = np.maximum(lens - WINDOW + 1, 0)
    total = int(count.sum())
    if not total:
        return exchange.Entries.none()
    of = np.repeat(np.arange(len(lens)), lens)
    n = len(words)
    s = Symbols(words, np.arange(n), np.arange(n) + 1, of)
    levels = [s]
    for k in range(ROUNDS):
        s = paired(runs(s, first), first, k)
        levels.append(s)
    wdoc = np.repeat(np.arange(len(lens)), count)
    p = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + first[:-1][wdoc]
    level, a, b = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    todo = np.arange(total)
    for k in range(ROUNDS, -1, -1):
        s = levels[k]
        q = p[todo]
        lo, hi = np.searchsorted(s.dl, q), np.searchsorted(s.dr, q + WINDOW, side="right")
        has = hi > lo
        own, lo, hi = todo[has], lo[has], hi[has]
        best, least = lo.copy(), s.name[lo]
        for j in range(1, int((hi - lo).max(initial=1))):
            c = np.minimum(lo + j, len(s.name) - 1)
            better = (lo + j < hi) & (s.name[c] < least)
            best[better], least[better] = c[better], s.name[c[better]]
        level[own], a[own], b[own] = k, s.dl[best], s.dr[best]
        todo = todo[~has]
        if not len(todo):
            break
    new = np.ones(total, bool)
    new[1:] = (wdoc[1:] != wdoc[:-1]) | (level[1:] != level[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], total) - 1
    prefix = Prefix(words)
    anchor = mix(prefix(a[head], b[head]) + level[head].astype(np.uint64))
    ctx = mix(prefix(p[head], p[tail] + WINDOW) + (a[head] - p[head]).astype(np.uint64)) ^ anchor
    check = Prefix(checks, CHECK_BASE)(p[head], p[tail] + WINDOW)
    doc = wdoc[head]
    return exchange.Entries(doc, p[head] - first[:-1][doc], p[tail] - first[:-1][doc], anchor, ctx, check)


def settle(id, at, anchor, ctx, check, flag, hot):
    """Entries in order of anchor, context, id and place: all but a context's first repeat; first ones of several contexts are open."""
    g, c = exchange._groups(anchor), exchange._groups(anchor, ctx, check)
    head = np.flatnonzero(c)[np.cumsum(c) - 1]
    is_first = (id == id[head]) & (at == at[head])
    contexts = np.add.reduceat(c.astype(np.int64), np.flatnonzero(g))[np.cumsum(g) - 1]
    return np.where(~is_first, exchange.REPEATED, np.where(hot | (contexts > 1), exchange.ASK, 0)).astype(np.uint8)


def _expand(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... for count[i] each."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)


def ask(t: Texts, e: exchange.Entries, at: np.ndarray, ids: np.ndarray, version: np.ndarray, code: np.ndarray):
    """The windows of the open entries by hash, reduced to the first of each; the others repeat."""
    starts, ends, first = word_spans(t)
    windows = window_hashes(span_hashes(t.data, starts, ends), WINDOW)
    checks = window_hashes(span_hashes(t.data, starts, ends, seed=CHECK_SEED), WINDOW, seed=CHECK_SEED)
    count = e.hi[at] - e.lo[at] + 1
    doc = np.repeat(e.doc[at], count)
    place = _expand(e.lo[at], count)
    h, check = windows[first[:-1][doc] + place], checks[first[:-1][doc] + place]
    id_ = ids[doc]
    order = np.lexsort((place, id_, check, h))
    h, check, id_, place, doc = h[order], check[order], id_[order], place[order], doc[order]
    new = exchange._groups(h, check)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (id_ != id_[head]) | (place != place[head])
    known = np.stack([doc[later], place[later]], axis=1)
    on = ~later
    cols = {"id": id_[on], "at": place[on] | (version[doc[on]] << 40), "hash": h[on], "check": check[on]}
    return (mix(h[on]) >> np.uint64(1)).astype(np.int64), cols, known, doc[on]


def resolve(q: dict[str, np.ndarray]):
    """All but the first place of a window repeat."""
    plain = q["at"] & ((1 << 40) - 1)
    order = np.lexsort((plain, q["id"], q["check"], q["hash"]))
    h, check, i, p, at = q["hash"][order], q["check"][order], q["id"][order], plain[order], q["at"][order]
    new = exchange._groups(h, check)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (i != i[head]) | (p != p[head])
    return i[later], at[later], np.ones(int(later.sum()), np.int32)


def finish(raw: bytes, ranges: list | None, texts: bool) -> tuple:
    """Words, words removed, runs removed, digest of the kept words, and the text with removed words cut out."""
    words = raw.split()
    if not ranges:
        return len(words), 0, 0, hashlib.sha256(b" ".join(words)).hexdigest(), None
    spans = exchange.merged(ranges, WINDOW)
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    text = None
    if texts:
        starts, _, _ = word_spans(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        cut, upto = [], 0
        for a, b in spans:
            cut.append(raw[upto : starts[a]])
            upto = int(starts[b]) if b < len(starts) else len(raw)
        text = b"".join([*cut, raw[upto:]])
    return len(words), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b" ".join(kept)).hexdigest(), text


OPERATOR = exchange.Repeats(find, settle, ask, resolve, finish, same_place_counts=False)


def report(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of each row; with `texts`, the text that is left too.

    A window repeats if its words also start at a smaller doc_id, or earlier in the
    same text; windows are judged on the input. Null and empty texts have no words.
    A null doc_id counts as smallest. Rows that share a doc_id count as one document:
    the same window at the same place of both repeats in neither. Ties beyond that don't exist.
    """
    out = exchange.deduplicated(docs, OPERATOR, texts)
    return out.select("doc_id", F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"), *(["text"] if texts else []))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated words cut out of text; other columns, and texts without repeats, stay as they are (null becomes empty)."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    return exchange.deduplicated(docs, OPERATOR, keep=keep).select(*docs.columns)
