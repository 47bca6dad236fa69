"""Helpers shared by the operators: tables, shared folders, and NumPy views of text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import shared_dir, spread, written  # noqa: F401  for the operators

#: Bytes of text that the NumPy code handles at once; bounds the memory of a worker.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; documents over all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name == "documents" else scan


def discard(*tables: DataFrame) -> None:
    """Deletes written tables of which nothing that is still to run reads; what was made from them must be written itself."""
    for t in tables:
        jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def in_shards(col: str = "doc_id") -> object:
    """True for rows that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5, F.lit(0)) != 0


class Texts:
    """A run of texts as one byte array: text i is data[offsets[i]:offsets[i + 1]]; null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None):
        self.data, self.offsets, self.valid = data, offsets, valid

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.offsets, at, side="right") - 1


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    if n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False)) if column.null_count else None
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return Texts(raw, offsets - lo, valid)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; one longer text is a batch of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        off = texts_of(b.column(b.schema.get_field_index(text))).offsets
        if off[-1] <= limit:
            yield b
            continue
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(t: Texts, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs of bytes not in `space`), and the first word of each text (n + 1 entries)."""
    if not len(t.data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(t) + 1, np.int64)
    solid = ~space[t.data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = t.offsets[1:] > t.offsets[:-1]
    s, e = t.offsets[:-1][full], t.offsets[1:][full] - 1
    first[s], last[e] = solid[s], solid[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, t.offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span data[starts[i]:ends[i]]; spans are disjoint, ascending and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    byte = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 7))
    lo, hi = int(starts[0]), int(ends[-1])
    inner = np.ones(hi - lo, np.int64)
    inner[starts[1:] - lo] = 1 - (starts[1:] - starts[:-1])
    inner[0] = 0
    at = np.cumsum(inner)  # place within the span, and on through the gap behind it
    solid = at < np.repeat(lens, np.diff(np.append(starts, hi)))
    at *= solid
    value = byte[data[lo:hi]] * powers(0x9E3779B97F4A7C15, int(lens.max()) + 1)[at]
    value[~solid] = 0
    return mix(np.add.reduceat(value, starts - lo) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words, by its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(mix(np.arange(k, dtype=np.uint64) + np.uint64(seed * 7919))):
        out += words[j : j + n] * (c | np.uint64(1))
    return mix(out)
