"""Token counts through a digest cache.

A count depends on the content and on the tokenizer alone, so that it is kept
under the digests of both. Only distinct contents that the cache lacks are
encoded; their counts are appended, and every document takes its count by a join.
The digests of all rows are written once; misses are found among them, without texts.
Then one pass over the texts reduces the copies of each task to one by a partial
aggregate before any text moves, so that a content of a third of all rows costs one row
a task, and each missing text moves once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import pieces, written

#: Digests of misses that are broadcast at most, 32 bytes each; with more, all texts meet the misses by a shuffle.
BROADCAST_MISSES = 100_000
CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"
#: Longer texts are counted in parts, cut where the count is additive: before one blank between two plain characters.
PART_CHARS = 1 << 18
_CUT = re.compile(r"(?<=[A-Za-z0-9])[ \n](?=[A-Za-z0-9])")


def normalised(text: Column) -> Column:
    """The content that is counted: the tokenizer normalises nothing, so that only null becomes empty."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    """Of the file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def parts(text: str) -> list[str]:
    """Parts whose counts add up to the text's."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        m = _CUT.search(text, at + PART_CHARS)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def counter(raw: bytes, kind: str):
    """A function from texts to token counts, without added tokens."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(raw.decode())
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def encoded(misses: DataFrame, tokenizer_path: str) -> DataFrame:
    """content and n_tokens of each row of (content, text)."""
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a tokenizer file over 64 MB isn't broadcast")
    sent, kind = misses.sparkSession.sparkContext.broadcast(raw), tokenizer_path.rpartition(".")[2]
    additive = kind == "json"  # sentencepiece sees the whole text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value, kind)
        for b in pieces(batches, limit=1 << 20):
            n = []
            for text in b.column(1).to_pylist():
                n.append(parts(text) if additive and len(text) > PART_CHARS else [text])
            flat = iter(count([p for ps in n for p in ps]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(next(flat) for _ in ps) for ps in n], pa.int64())], names=["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, broadcast_misses: int = BROADCAST_MISSES) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row; `cache_path` is a Parquet folder that is read and appended to.

    Null and empty texts have no bytes and no tokens; repeated rows give repeated
    rows; a null doc_id stays null, and rows are never told apart by it. The append
    is one write: a failed run leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    def cache() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")

    text = normalised(F.col("text"))
    digest = F.unhex(F.sha2(text, 256)).alias("content")
    of = written(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")), "token-digests")
    contents = of.select("content").distinct()
    missing = written(contents.join(cache(), "content", "left_anti"), "token-misses")
    n_missing = missing.count()
    if n_missing:
        full, one = docs.select(digest, text.alias("text")), F.first("text").alias("text")
        # a task's copies become one before anything moves
        if n_missing <= broadcast_misses:
            todo = full.join(F.broadcast(missing), "content", "left_semi").groupBy("content").agg(one)
        else:
            todo = full.groupBy("content").agg(one).join(missing, "content", "left_semi")
        made = encoded(todo, tokenizer_path)
        made.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    # a table of its own, so that adaptive execution can split a hot content's side of the join
    counts = written(contents.join(cache(), "content").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return of.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")
