"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

Texts with equal shingle sets are one class, found by a digest with partial
aggregation, so that copies cost one row a task. Classes are cut into bands, whose
number and rows are chosen for the target recall at the threshold. Within a band the MinHashes of
its classes are compared first: only classes that agree in as many of them as a pair at the
threshold does (but for the same small risk) are linked, each to the least class of its part of the
band, so that chance meetings of unlike texts join nothing. The connected
components of these links hold every pair that may be similar. Only then do the texts of
components of two classes or more move, and the full sets of a component are compared.
A large component, or a large band, is dealt into blocks of bounded size, and every pair of
blocks is compared in a task of its own. Pairs are counted where they are found and never leave as rows; what leaves is, for each
class and task, its number of links and one edge to the least class it is linked with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Texts, discard, mix, pieces, span_hashes, texts_of, window_hashes, word_spans, written

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99999
BAND_ROWS = 5
#: Classes of one block, and shingles; a component (or, for classes, a band) with more is compared block by block.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Bits of the filter that texts pass before they move; its words are broadcast, one row for 64 bits.
FILTER_BITS = 1 << 24
#: Pairs of classes of a band that are compared at once.
PAIRS = 100_000


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands of `rows` MinHashes that finds a pair of this similarity with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def least_agreeing(similarity: float, recall: float, n: int) -> int:
    """The most of n MinHashes in which a pair of this similarity agrees at least, with this probability."""
    below = 0.0
    for c in range(n + 1):
        below += math.comb(n, c) * similarity**c * (1 - similarity) ** (n - c)
        if below > 1 - recall:
            return c
    return n


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the first of each text.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    starts, ends, first = word_spans(t)
    n = np.diff(first)
    words = span_hashes(t.data, starts, ends)
    windows = window_hashes(words, k)
    count = np.maximum(n - k + 1, 0)
    of = np.repeat(np.arange(len(t)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    h = windows[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([int(window_hashes(words[first[i] : first[i + 1]], int(n[i]), seed=2)[0]) for i in short], np.uint64)
        of, h = np.concatenate([of, short]), np.concatenate([h, own])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    of, h = of[new], h[new]
    return h, np.searchsorted(of, np.arange(len(t) + 1))


def _keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of 128 bits of each set; all zero for an empty one."""
    n = len(first) - 1
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        size = np.diff(first)[full].astype(np.uint64)
        for j, salt in enumerate((0x51ED, 0xC0FFEE)):
            out[full, j] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), first[:-1][full]) + size)
    return out


def signatures(h: np.ndarray, first: np.ndarray, bands: int, rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each set that isn't empty (others 0), and a byte of each of its MinHashes."""
    n = len(first) - 1
    out, sketch = np.zeros((n, bands), np.uint64), np.zeros((n, bands * rows), np.uint8)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out, sketch
    at = first[:-1][full]
    factors = mix(np.arange(bands * rows, dtype=np.uint64) + np.uint64(seed * 1000003)) | np.uint64(1)
    # by runs of sets, so that a run's hashes stay in the processor's cache
    size, start = 1 << 16, 0
    while start < len(full):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + size)))
        a = int(at[start])
        b = int(at[stop]) if stop < len(full) else len(h)
        part, cut = h[a:b], at[start:stop] - a
        buf = np.empty_like(part)
        for band in range(bands):
            code = np.full(stop - start, band + 1, np.uint64)
            for r in range(rows):
                np.multiply(part, factors[band * rows + r], out=buf)
                least = np.minimum.reduceat(buf, cut)
                sketch[full[start:stop], band * rows + r] = (least & np.uint64(0xFF)).astype(np.uint8)
                code = mix(code + least)
            out[full[start:stop], band] = code
        start = stop
    return out, sketch


def classes(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the other columns, key (digest of the shingle set; null if empty), size, bands and sketch of each row of (doc_id, text, ...)."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, first = shingle_sets(texts_of(b.column(1)), k)
            keys = _keys(h, first)
            sig, sketch = signatures(h, first, bands, rows)
            size = np.diff(first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sig) + 1) * bands, bands, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()))
            raw = pa.array([x.tobytes() if n else None for n, x in zip(size.tolist(), keys)], pa.binary())
            made = [raw, pa.array(size.astype(np.int64)), lists, pa.array([x.tobytes() for x in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(2 + i) for i in range(len(keep))), *made], names=["doc_id", *keep, "key", "size", "bands", "sketch"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return rows_in.mapInArrow(run, f"doc_id long, {kinds}key binary, size long, bands array<long>, sketch binary")


def _least_of_parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of the connected part of each of 0 .. n - 1, given links (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def agreeing_parts(group: np.ndarray, sketch: np.ndarray, least: int) -> np.ndarray:
    """For each row, the first row of its part: rows of a group (equal numbers stand together) that agree in `least` places are linked."""
    n = len(group)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    start, size = np.repeat(head, size), np.repeat(size, size)
    with_head = (sketch == sketch[start]).sum(axis=1) >= least
    links = [np.stack([np.flatnonzero(with_head), start[with_head]])]
    # rows that agree with the first are linked through it; the others meet every row of their group
    rest = np.flatnonzero(~with_head)
    upto = np.cumsum(size[rest])
    at = 0
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)))
        own = rest[at:stop]
        a = np.repeat(own, size[own])
        b = np.arange(len(a)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + np.repeat(start[own], size[own])
        hit = (sketch[a] == sketch[b]).sum(axis=1) >= least
        links.append(np.stack([a[hit], b[hit]]))
        at = stop
    a, b = np.concatenate(links, axis=1)
    return _least_of_parts(n, a, b)


def band_links(per_class: DataFrame, least: int, block: int) -> DataFrame:
    """Edges (u, v) from classes to the least class of their part of a band, or of a pair of a band's blocks."""
    banded = per_class.select("key", F.explode("bands").alias("band"))
    sized = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    shared = banded.join(sized, "band").join(per_class.select("key", "sketch"), "key")
    shared = shared.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "sketch")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(t: pa.Table, numbers: np.ndarray) -> pa.RecordBatch:
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            low = agreeing_parts(numbers, sketch, least)
            on = np.flatnonzero(low != np.arange(len(low)))
            keys = t["key"].combine_chunks()
            return pa.RecordBatch.from_arrays([keys.take(pa.array(on)), keys.take(pa.array(low[on]))], names=["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            cols = [held[c].to_numpy() for c in ("band", "lo", "hi")]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            if last:
                yield made(held.slice(0, last), np.cumsum(new)[:last])
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield made(held, np.zeros(held.num_rows, np.int64))

    return dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "key").mapInArrow(linked, "u binary, v binary")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the least node of its connected component) of every node of edges (u, v).

    Alternates large-star and small-star steps, each of which leaves a row for each
    row it gets at most; each round is a written table, so that lost executors lose no round.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    n = e.count()
    while n:
        # the least neighbour of every node that has a smaller one; a table of its own, so that a hub's side of the join can be split
        lows = written(e.groupBy("u").agg(F.min("v").alias("m")), name)
        low = lows.select(F.col("u").alias("v"), "m")
        if low.count() == n and e.join(low, "v", "left_semi").isEmpty():
            break  # every node has one link, to a node without any: stars around the roots
        # large star: every larger neighbour of v goes to the least of v and its neighbours
        large = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")
        old, e = e, written(large.join(least, "u").select(both).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), name)
        n = e.count()
        discard(old, lows)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def similar(h: np.ndarray, first: np.ndarray, at_least: Fraction, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether set i of `left` and set j of `right` have this Jaccard similarity, by exact counts."""
    size = np.diff(first)
    of = np.repeat(np.arange(len(size)), size)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # others are in one set only
    number = np.cumsum(times > 1) - 1
    of, column = of[shared], number[column[shared]]
    width = int((times > 1).sum())
    inter = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(size), -1)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    chunk = 4096
    for a in range(0, width, chunk):
        lo, hi = np.searchsorted(column, [a, a + chunk])
        w = min(chunk, width - a)
        sides = []
        for own in (left, right):
            place[:] = -1
            place[own] = np.arange(len(own))
            row = place[of[lo:hi]]
            m = np.zeros((len(own), w), np.float32)
            m[row[row >= 0], column[lo:hi][row >= 0] - a] = 1
            sides.append(m)
        inter += sides[0] @ sides[1].T
    inter = inter.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - inter
    return inter * at_least.denominator >= union * at_least.numerator


def _compare(t: pa.Table, k: int, at_least: Fraction) -> pa.Table:
    """Links and one edge of each class of a block, or of a pair of blocks, with each other."""
    names = ["key", "links", "low", "whole"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
    h, first = shingle_sets(texts_of(t["text"]), k)
    own = [x.tobytes() for x in _keys(h, first)]
    # a doc_id may bring several texts: only those of the class count, once
    seen: set = set()
    good = [i for i, (x, key) in enumerate(zip(own, t["key"].to_pylist())) if x == key and not (key in seen or seen.add(key))]
    if len(good) < 2:
        return pa.table([pa.array([], x) for x in types], names=names)
    good = np.array(sorted(good, key=lambda i: own[i]))
    lo, hi, block, copies = (t[c].to_numpy()[good] for c in ("lo", "hi", "block", "copies"))
    if lo[0] == hi[0]:
        left = right = np.arange(len(good))
    else:
        left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
    hit = similar(h, first, at_least, good[left], good[right])
    links = np.zeros(len(good), np.int64)
    links[left] += hit @ copies[right]
    if lo[0] == hi[0]:
        links -= copies * np.diagonal(hit)
    else:
        links[right] += hit.T @ copies[left]
    i, j = np.nonzero(hit)
    low = _least_of_parts(len(good), left[i], right[j])  # good is in order of keys
    keep = np.flatnonzero(links > 0)
    return pa.table([pa.array([own[good[i]] for i in keep], types[0]), pa.array(links[keep]), pa.array([own[good[low[i]]] for i in keep], types[2]), pa.array([bool(t["whole"][0].as_py())] * len(keep), types[3])], names=names)


def _only_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id may be one of `wanted`, all that are among them: a bitmap of hashes, of bounded size, spares the others a shuffle."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = wanted.select(word.alias("__word"), bit.alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))  # FILTER_BITS / 64 rows at most
    kept = rows.withColumn("__word", word).join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return kept.drop("__word", "__bits")


def _grouped(docs: DataFrame, keep: list[str], similarity: float, k: int, recall: float, band_rows: int, block: int, block_shingles: int) -> DataFrame:
    """doc_id, the `keep` columns, root (the class by a digest; null if the row has no words), class_id, n_links and copy_of of each row."""
    at_least = Fraction(similarity).limit_denominator(1000)
    bands = bands_for(similarity, recall, band_rows)
    least = least_agreeing(similarity, recall, bands * band_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    found = written(classes(rows, k, bands, band_rows), "ngram-sets")  # read twice, made once
    per_class = found.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "bands", "sketch")))
    per_class = written(per_class, "ngram-classes")
    candidates = components(band_links(per_class, least, block), "ngram-candidates")

    of = per_class.select(F.col("key").alias("node"), "copy_of", "copies", "size")
    placed = written(candidates.join(of, "node"), "ngram-placed")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / block_shingles)).cast("int")
    # sizes and names of components are tables of their own, so that a hot component's side of the joins can be split
    sized = written(placed.groupBy("root").agg(blocks.alias("blocks")), "ngram-sizes")
    mine = placed.join(sized, "root")
    mine = mine.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mine = mine.select(F.col("copy_of").alias("doc_id"), F.col("node").alias("key"), "root", "blocks", "block", "copies")
    texts = _only_wanted(rows.select("doc_id", "text").where("doc_id is not null"), placed.select(F.col("copy_of").alias("doc_id"))).join(mine, "doc_id")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", "key", "copies", "block", "text", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("blocks") == 1).alias("whole"))
    compared = dealt.groupBy("root", "lo", "hi").applyInArrow(lambda t: _compare(t, k, at_least), "key binary, links long, low binary, whole boolean")
    links = written(compared, "ngram-links")
    discard(placed, sized)
    total = links.groupBy("key").agg(F.sum("links").alias("links"))
    # where one task had the whole component, its parts are settled; the rest are joined up
    roots = links.where("whole").select(F.col("key").alias("node"), F.col("low").alias("root"))
    roots = roots.unionByName(components(links.where("not whole").select(F.col("key").alias("u"), F.col("low").alias("v")), "ngram-components"))
    group = per_class.select("key", "copy_of", "copies").join(total, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    group = written(group.withColumn("root", F.coalesce("root", "key")), "ngram-groups")
    named = written(group.groupBy("root").agg(F.min("copy_of").alias("class_id")), "ngram-names")
    verdict = group.join(named, "root").select("key", "root", "class_id", "copy_of", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    verdict = written(verdict, "ngram-verdicts")  # for the same reason: a hot class
    discard(per_class, links, group, named)
    out = found.select("doc_id", *keep, "key").join(verdict, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id"))
    return out.select("doc_id", *keep, "root", F.coalesce(F.col("class_id"), own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("copy_of"), own).alias("copy_of"))


def join(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, recall: float = RECALL, band_rows: int = BAND_ROWS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, class_id, n_links and copy_of of each row.

    n_links counts the other rows whose set of k-word shingles has at least this
    Jaccard similarity, copies included. class_id is the smallest doc_id of the connected
    component of such links, copy_of the smallest doc_id with an equal set. A text
    of fewer than k words is one shingle. A text without words, or null, has no
    links and is its own class. Of rows with a null doc_id, those whose set another row with an id has
    share its class and links; the others are linked to their copies only, and their class_id is null.
    doc_id is a whole number, or a string of one.
    """
    return _grouped(docs, [], similarity, k, recall, band_rows, block, block_shingles).select("doc_id", "class_id", "n_links", "copy_of")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, recall: float = RECALL, band_rows: int = BAND_ROWS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row of each class of `join`, all columns as they were.

    Rows are told apart by all their columns. The row that stays is that of the smallest
    doc_id (null ids last), and of several rows with it that of the least digest; rows
    equal in every column are one. Rows without words are classes of their own and stay. Of rows
    with a null doc_id whose class has no id, one of each set of copies stays.
    """
    one, two = ("__row" + x + "_" * sum(c.startswith("__row") for c in docs.columns) for x in "ab")
    plain = [F.col(c) for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    rows = docs.withColumns({one: F.xxhash64(F.lit(1), *plain), two: F.xxhash64(F.lit(2), *plain)})
    found = written(_grouped(rows, [one, two], similarity, k, recall, band_rows, block, block_shingles).select("doc_id", "root", one, two), "ngram-rows")
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", one, two)).alias("x"))
    stay = best.select(f"x.{one}", f"x.{two}").unionByName(found.where("root is null").select(one, two).distinct())
    # a task's equal rows become one before anything moves, and the join finds the rows dealt out as it needs them
    return rows.dropDuplicates([one, two]).join(stay, [one, two], "left_semi").select(*docs.columns)
