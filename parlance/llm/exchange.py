"""Finding repeats across all documents without bringing any group together.

Both repeat operators share this course. Every window of a text belongs to an
anchor that its content alone selects, so that equal windows have equal anchors.

1. Each batch of texts (a partition, or some 80 MB of one) lists its entries: an anchor, and the context (the text of
   the run of windows that belong to it). Within the batch, equal contexts are reduced to their
   first, so that a text of a third of all rows is one entry a batch. Contexts are equal if two
   independent 64-bit hashes are: the second verifies what the first reveals.
2. Entries meet by anchor. Equal contexts settle each other at once; only where
   an anchor has several contexts does one of each have to be compared further.
   An anchor with many contexts in a batch is hot there: its entries meet by context instead, spread over all
   buckets, and the anchor's own bucket learns that it is hot and sends on what others sent it.
3. Replies are written. A bitmap of the hashes of their ids, of bounded size, lets texts that have
   none be finished where they are; the others, and few besides, meet their replies by a hash of doc_id
   and ask about the contexts that are open, again reduced to distinct ones. What
   comes of this is written, and texts that are done are read from there.
4. Questions meet by content, are resolved, and the answers return to the texts.

All rows that travel are packed arrays, a row for each batch and bucket. There is one
bucket for each of spark.sql.shuffle.partitions, which a user sizes to the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import CHUNK_BYTES, Texts, mix, pieces, texts_of, written

#: What a null doc_id counts as: smaller than any other.
NULL_ID = -(1 << 63)
#: Codes of a reply: compare the context further; all its windows repeat; both.
ASK, REPEATED, REPEATED_ASK = 1, 2, 3
#: Flags of an entry: the only one of its context in the batch; the first of several; one after the first;
#: that the anchor is hot; HOT is added where the entry belongs to a hot anchor.
ONLY, FIRST, LATER, MARK, HOT = 0, 1, 2, 3, 8
#: Entries that a task holds before it reduces and sends them: some 80 MB of text, or its whole partition.
HELD_ENTRIES = 2_000_000
#: Bits of the filter of ids that have replies; a row of its broadcast table holds 64.
FILTER_BITS = 1 << 24
#: Contexts of an anchor in one batch that make it hot.
HOT_CONTEXTS = 64


def xxhash64(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for a bigint."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.full(len(x), seed, np.uint64) + p5 + np.uint64(8)
    h ^= turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


@dataclass
class Entries:
    """doc: index of the text; lo, hi: first and last start of its windows in the text; anchor, ctx: hashes; check: one of the context by another function, which verifies an equal ctx."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    ctx: np.ndarray
    check: np.ndarray

    @staticmethod
    def none() -> Entries:
        return Entries(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)))


@dataclass
class Repeats:
    """What an operator brings to the course; all functions run on the executors.

    find: entries of texts. settle: codes of the entries of a bucket, in order of anchor, context (ctx, check), id and place, and whether all are of hot anchors. ask: packed
    columns of the open entries, with a bucket hash. resolve: answers (id, at, count)
    to the questions of a bucket: starts at .. at + count - 1 repeat. finish: n,
    removed, spans, sha and kept text, given the ranges of repeated starts.
    """

    find: Callable[[Texts], Entries]
    settle: Callable[..., np.ndarray]
    ask: Callable[..., tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]]
    resolve: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    finish: Callable[..., tuple]
    same_place_counts: bool  # whether an equal place of a repeated row is a second place
    repeated: tuple[int, ...] = (REPEATED, REPEATED_ASK)  # codes that say that all windows repeat


FIELDS = ["id", "at", "anchor", "ctx", "check", "flag"]
ENTRY = "bucket int, " + ", ".join(f"{c} binary" for c in FIELDS)
SETTLED = [*FIELDS, "code"]
REPLY = "slot int, id binary, at binary, ctx binary, code binary"
_TYPES = {"id": np.int64, "at": np.int64, "anchor": np.uint64, "ctx": np.uint64, "check": np.uint64, "flag": np.uint8, "code": np.uint8, "count": np.int32, "hash": np.uint64, "len": np.int32, "own": np.int32, "data": np.uint8}
#: Narrower forms while they travel.
_PACKED = {"at": np.int32, "anchor": np.uint32, "check": np.uint32}


def _cut(order_key: np.ndarray, cols: dict[str, np.ndarray], packed: dict) -> Iterator[tuple[int, dict[str, bytes]]]:
    """The columns dealt out by order_key: each key with its rows as bytes."""
    order = np.argsort(order_key, kind="stable")
    key = order_key[order]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
    moved = {c: np.ascontiguousarray(v[order].astype(packed.get(c, v.dtype))) for c, v in cols.items()}
    for a, b in zip(edges, [*edges[1:], len(key)]):
        yield int(key[a]), {c: v[a:b].tobytes() for c, v in moved.items()}


def _joined(t: pa.Table, name: str, packed: dict) -> np.ndarray:
    raw = b"".join(x.as_py() or b"" for x in t.column(name))
    return np.frombuffer(raw, packed.get(name, _TYPES[name])).astype(_TYPES[name])


def _ids(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys starts a new group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _anchor_key(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def partition_labels(spark: SparkSession, n: int) -> np.ndarray:
    """n whole numbers that Spark's hash partitioning puts into n different partitions, in their order."""
    reach = n * (int(np.log(n + 1)) + 8)
    while True:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        rows = spark.range(0, reach, 1, 1).groupBy(place.alias("p")).agg(F.min("id").alias("id")).collect()
        if len(rows) == n:
            return np.array([r["id"] for r in sorted(rows, key=lambda r: r["p"])], np.int32)
        reach *= 2


def deduplicated(docs: DataFrame, op: Repeats, texts: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n, removed, spans and sha of each row, and with `texts` the text that is left; with `keep`, doc_id, that text and these columns instead."""
    spark, plain = docs.sparkSession, keep is None
    texts, keep = texts or not plain, keep or []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = partition_labels(spark, n)
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    number = F.pmod(hashed, F.lit(n)).cast("int")
    slot = F.get(F.lit(labels.tolist()), number)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), slot.alias("slot"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    kept_types = [(f"k{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0
        for b in pieces(batches):
            e = op.find(texts_of(b.column(1)))
            if len(e.doc):
                held.append((_ids(b.column(0))[e.doc], e.lo.astype(np.int64), e.anchor, e.ctx, e.check))
                n_held += len(e.doc)
            if n_held >= HELD_ENTRIES:
                yield reduced(*(np.concatenate(x) for x in zip(*held)))
                held, n_held = [], 0
        if held:
            yield reduced(*(np.concatenate(x) for x in zip(*held)))

    def reduced(ids: np.ndarray, at: np.ndarray, anchor: np.ndarray, ctx: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        """Entries of a batch with equal contexts settled among themselves, a row for each bucket."""
        order = np.lexsort((at, ids, check, ctx, anchor))
        ids, at, anchor, ctx, check = ids[order], at[order], anchor[order], ctx[order], check[order]
        first = _groups(anchor, ctx, check)
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        same = (ids == ids[head]) & (at == at[head])
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        differs = np.add.reduceat((~same).astype(np.int64), np.flatnonzero(first))
        many = size > 1 if op.same_place_counts else differs > 0
        flag = np.where(first, np.where(np.repeat(many, size), FIRST, ONLY), LATER).astype(np.uint8)
        on = first | ~same
        new = _groups(anchor)
        contexts = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        hot = contexts > HOT_CONTEXTS
        told = new & hot  # one mark for each hot anchor, which goes to the anchor's bucket
        home = (anchor >> np.uint64(33)) % np.uint64(n)
        away = (mix(anchor ^ ctx) >> np.uint64(33)) % np.uint64(n)
        key = np.concatenate([np.where(hot, away, home)[on], home[told]]).astype(np.int64)
        flag = flag + (HOT * hot).astype(np.uint8)
        mark = np.full(int(told.sum()), MARK, np.uint8)
        cols = {c: np.concatenate([v[on], v[told]]) for c, v in (("id", ids), ("at", at), ("anchor", anchor), ("ctx", ctx), ("check", check))} | {"flag": np.concatenate([flag[on], mark])}
        made = list(_cut(labels[key], cols, _PACKED))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), *(pa.array([v[c] for _, v in made], pa.binary()) for c in cols)], names=["bucket", *cols])

    def entries_in(t: pa.Table) -> dict[str, np.ndarray]:
        got = {c: _joined(t, c, _PACKED) for c in FIELDS}
        order = np.lexsort((got["flag"], got["at"], got["id"], got["check"], got["ctx"], got["anchor"]))
        return {c: v[order] for c, v in got.items()}

    def replies_to(got: dict[str, np.ndarray], hot: bool) -> pa.Table:
        """Replies, a row for each slot."""
        code = op.settle(**got, hot=hot) if len(got["id"]) else np.zeros(0, np.uint8)
        on = code > 0
        cols = {"id": got["id"][on], "at": got["at"][on], "ctx": got["ctx"][on], "code": code[on].astype(np.uint8)}
        made = list(_cut(labels[np.mod(xxhash64(cols["id"]), n)], cols, _PACKED))
        empty = pa.nulls(len(made), pa.binary())
        given = {c: pa.array([v[c] for _, v in made], pa.binary()) for c in cols}
        return pa.table([pa.array([k for k, _ in made], pa.int32()), *(given.get(c, empty) for c in SETTLED)], names=["bucket", *SETTLED])

    def settle(t: pa.Table) -> pa.Table:
        """Replies to the entries of anchors that aren't hot; those of hot ones go on, by context."""
        got = entries_in(t)
        told = np.unique(got["anchor"][got["flag"] == MARK])
        moved = (got["flag"] < MARK) & np.isin(got["anchor"], told)  # sent here by batches in which the anchor isn't hot
        away = got["flag"] >= HOT  # sent to their context's bucket already
        stay = ~moved & ~away & (got["flag"] != MARK)
        out = [replies_to({c: v[stay] for c, v in got.items()}, False)]
        for own in (moved, away):
            cols = {c: v[own] for c, v in got.items()} | {"flag": got["flag"][own] & np.uint8(HOT - 1)}
            # an anchor has lost its high bits on the way here, so that the bucket is that of anchor and context as they are now
            key = (mix(mix(cols["anchor"]) ^ cols["ctx"]) >> np.uint64(33)) % np.uint64(n)
            made = list(_cut(labels[key.astype(np.int64)], cols, _PACKED))
            empty = pa.nulls(len(made), pa.binary())
            out.append(pa.table([pa.array([k for k, _ in made], pa.int32()), *(pa.array([v[c] for _, v in made], pa.binary()) if c in cols else empty for c in SETTLED)], names=["bucket", *SETTLED]))
        return pa.concat_tables(out)

    def settle_hot(t: pa.Table) -> pa.Table:
        """Replies to what is left, and those that are there already."""
        ready = t.filter(pa.compute.is_valid(t["code"]))
        out = pa.concat_tables([ready, replies_to(entries_in(t.filter(pa.compute.is_valid(t["flag"]))), True)])
        return out.select(["bucket", "id", "at", "ctx", "code"]).rename_columns(["slot", "id", "at", "ctx", "code"])

    own = [("doc_id", "bigint"), ("n", "bigint"), ("removed", "bigint"), ("spans", "bigint"), ("sha", "string"), ("text", "string"), *kept_types]
    payload = ["id", "at", "hash", "check", "count", "len", "own", "data"]
    step = [("bucket", "int"), ("kind", "int"), *own, *((p, "binary") for p in payload)]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    DONE, OPEN, QUESTION = range(3)

    def rows_of(columns: dict, size: int, like: pa.Schema | None) -> pa.Table:
        """A table of the step's schema; what isn't given is null."""
        out = []
        for c, kind in step:
            given = columns.get(c)
            if given is None:
                type_ = like.field(c).type if like is not None and c in like.names else arrow.get(kind, pa.null())
                out.append(pa.nulls(size, type_))
            else:
                out.append(given if isinstance(given, (pa.Array, pa.ChunkedArray)) else pa.array(given, arrow[kind]))
        return pa.table(out, names=[c for c, _ in step])

    def finished(t: pa.Table, at: list[int], ranges: dict[int, list], raw: list[bytes]) -> dict:
        made = [op.finish(raw[i], ranges.get(i), texts) for i in at]
        picked = t.take(pa.array(at, pa.int64()))
        new = [None if m[4] is None else m[4].decode("utf-8", "replace") for m in made]
        text = pa.array([(x if x is not None else raw[i].decode()) if texts else None for x, i in zip(new, at)], pa.string())
        return {"kind": [DONE] * len(at), "doc_id": picked["doc_id"], "n": [m[0] for m in made], "removed": [m[1] for m in made], "spans": [m[2] for m in made], "sha": [m[3] for m in made], "text": text} | {k: picked[k] for k, _ in kept_types}

    def meet(d: pa.Table, r: pa.Table) -> pa.Table:
        if not d.num_rows:
            return rows_of({}, 0, d.schema)
        got = {c: _joined(r, c, _PACKED) for c in ("id", "at", "ctx", "code")}
        ids = _ids(d["doc_id"])
        slots = d["slot"].combine_chunks()
        raw = [x.encode() for x in d["text"].to_pylist()]
        every = np.flatnonzero(np.isin(ids, got["id"])) if len(got["id"]) else np.zeros(0, np.int64)
        key = lambda i, a, c: mix(mix(i.astype(np.int64).view(np.uint64)) + a.astype(np.int64).view(np.uint64)) ^ c
        have = key(got["id"], got["at"], got["ctx"])
        # repeated rows of several batches have a reply each, of equal keys: the highest code, which asks, comes first and counts
        order = np.lexsort((~got["code"], have))
        have, codes = have[order], got["code"][order]
        # texts that share a doc_id are told apart by a version in the high bits of a place
        versions = np.zeros(len(raw), np.int64)
        if len(np.unique(ids[every])) < len(every):
            seen: dict = {}
            for i in every.tolist():
                versions[i] = seen.setdefault(int(ids[i]), {}).setdefault(raw[i], len(seen[int(ids[i])]))
        ranges: dict[int, list] = {}
        waiting: list[int] = []
        out = []
        total = np.cumsum([len(raw[i]) for i in every]) if len(every) else np.zeros(0, np.int64)
        start = 0
        while start < len(every):  # as much text at once as memory is meant for
            stop = max(start + 1, int(np.searchsorted(total, total[start] + CHUNK_BYTES)))
            hit, start = every[start:stop], stop
            t = texts_of(pa.array([raw[i] for i in hit], pa.binary()))
            e = op.find(t)
            mine = key(ids[hit][e.doc], e.lo, e.ctx)
            place = np.minimum(np.searchsorted(have, mine), len(have) - 1)
            code = np.where(have[place] == mine, codes[place], 0)
            for k in np.flatnonzero(np.isin(code, op.repeated)).tolist():
                ranges.setdefault(int(hit[e.doc[k]]), []).append((int(e.lo[k]), int(e.hi[k])))
            ask = np.flatnonzero((code > 0) & (code != REPEATED))
            if len(ask):
                bucket, cols, known, stay = op.ask(t, e, ask, ids[hit], versions[hit], code)
                for k in known.tolist():  # (text, start) pairs that repeat within this chunk
                    ranges.setdefault(int(hit[k[0]]), []).append((k[1], k[1]))
                waiting += hit[np.unique(stay)].tolist()
                made = list(_cut_questions(labels[np.mod(bucket, n)], cols))
                out.append(rows_of({"bucket": [k for k, _ in made], "kind": [QUESTION] * len(made)} | {c: [v[c] for _, v in made] for c in cols}, len(made), d.schema))
        if waiting:
            at = sorted(waiting)
            picked = d.take(pa.array(at, pa.int64()))
            blobs = {"at": [np.array([x for p in ranges.get(i, []) for x in p], np.int32).tobytes() for i in at], "count": [np.array([versions[i]], np.int32).tobytes() for i in at]}
            out.append(rows_of({"bucket": slots.take(pa.array(at, pa.int64())), "kind": [OPEN] * len(at), "doc_id": picked["doc_id"], "text": picked["text"]} | blobs | {k: picked[k] for k, _ in kept_types}, len(at), d.schema))
        waiting = set(waiting)
        rest = [i for i in range(len(raw)) if i not in waiting]
        done = finished(d, rest, ranges, raw)
        out.append(rows_of(done | {"bucket": slots.take(pa.array(rest, pa.int64()))}, len(rest), d.schema))
        return pa.concat_tables(x.cast(out[-1].schema) for x in out)

    def resolve(t: pa.Table) -> pa.Table:
        """Answers to the questions of a bucket, a row for each slot."""
        ids, at, count = op.resolve({c: _joined(t, c, {}) for c in payload})
        made = list(_cut(labels[np.mod(xxhash64(ids), n)], {"id": ids, "at": at, "count": count.astype(np.int32)}, {}))
        return pa.table([pa.array([k for k, _ in made], pa.int32()), *(pa.array([v[c] for _, v in made], pa.binary()) for c in ("id", "at", "count"))], names=["bucket", "id", "at", "count"])

    def close(open_: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c for c, _ in own]
        if not open_.num_rows:
            return open_.select(names)
        a_id, a_at, a_n = (_joined(answers, c, {}) for c in ("id", "at", "count"))
        order = np.lexsort((a_at, a_id))
        a_id, a_at, a_n = a_id[order], a_at[order], a_n[order]
        ids = _ids(open_["doc_id"])
        raw = [x.encode() for x in open_["text"].to_pylist()]
        ranges = {}
        for i in range(len(raw)):
            known = np.frombuffer(open_["at"][i].as_py(), np.int32).reshape(-1, 2).tolist()
            version = int(np.frombuffer(open_["count"][i].as_py(), np.int32)[0])
            lo, hi = np.searchsorted(a_id, ids[i], "left"), np.searchsorted(a_id, ids[i], "right")
            at = a_at[lo:hi]
            mine = (at >> 40) == version
            at, more = at[mine] & ((1 << 40) - 1), a_n[lo:hi][mine]
            ranges[i] = [tuple(x) for x in known] + list(zip(at.tolist(), (at + more - 1).tolist()))
        done = finished(open_, list(range(len(raw))), ranges, raw)
        return rows_of(done, len(raw), open_.schema).select(names).cast(open_.select(names).schema)

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the filter that a task's replies set."""
        words = np.zeros(FILTER_BITS >> 6, np.uint64)
        for b in batches:
            place = np.unique(xxhash64(_joined(pa.Table.from_batches([b]), "id", {})) & np.int64(FILTER_BITS - 1))
            np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "bits"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without replies, finished."""
        names = [c for c, _ in own]
        for b in pieces(batches):
            t = pa.Table.from_batches([b])
            done = finished(t, list(range(b.num_rows)), {}, [x.encode() for x in t["text"].to_pylist()])
            yield from rows_of(done, b.num_rows, t.schema).select(names).to_batches()

    ddl = lambda cols: ", ".join(f"{c} {k}" for c, k in cols)
    found = rows.select("doc_id", "text").mapInArrow(entries, ENTRY)
    settled = found.groupBy("bucket").applyInArrow(settle, "bucket int, " + ", ".join(f"{c} binary" for c in SETTLED))
    replies = written(settled.groupBy("bucket").applyInArrow(settle_hot, REPLY), "repeats-replies")
    words = replies.select("id").mapInArrow(bitmap, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))  # FILTER_BITS / 64 rows at most
    place = F.pmod(hashed, F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marked = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word", "left").withColumn("near", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")
    rest = marked.where(~F.col("near")).drop("near", "slot").mapInArrow(untouched, ddl(own))
    rows = marked.where("near").drop("near")
    met = rows.groupBy("slot").cogroup(replies.groupBy("slot")).applyInArrow(meet, ddl(step))
    # written, so that texts that are done move no further, and open ones once, to the answers
    met = written(met, "repeats-met")
    kind = lambda k: met.where(F.col("kind") == k)
    answers = kind(QUESTION).select("bucket", *payload).groupBy("bucket").applyInArrow(resolve, "bucket int, id binary, at binary, count binary")
    closed = kind(OPEN).groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(close, ddl(own))
    out = rest.unionByName(kind(DONE).select(*(c for c, _ in own))).unionByName(closed)
    if plain:
        return out.select("doc_id", "n", "removed", "spans", "sha", *(["text"] if texts else []))
    return out.select("doc_id", "text", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def _cut_questions(key: np.ndarray, cols: dict) -> Iterator[tuple[int, dict[str, bytes]]]:
    """As _cut; a column "data" holds, for each row, "len" bytes."""
    if "data" not in cols:
        yield from _cut(key, cols, {})
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    length, ends = cols["len"], np.cumsum(cols["len"], dtype=np.int64)
    starts = ends - length
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
    for a, b in zip(edges, [*edges[1:], len(key)]):
        own = order[a:b]
        out = {c: np.ascontiguousarray(v[own]).tobytes() for c, v in cols.items() if c != "data"}
        out["data"] = b"".join(cols["data"][starts[i] : ends[i]].tobytes() for i in own.tolist())
        yield int(key[a]), out


def merged(ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Starts lo..hi of windows of `width` as disjoint spans [a, b), in order; touching spans are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + width)
        else:
            out.append([lo, hi + width])
    return [(a, b) for a, b in out]
