"""Benchmark decontamination inside the JVM.

Test items become windows of 13 words (an item of fewer words is one window). Their
hashes are broadcast, once their number is checked. Every window start of every text probes them
by hash, and a hit is verified word by word in the join's condition. Only hits, and one marker
a text, reach the shuffle by text. Beyond the bound the join shuffles, but only the places that
pass a filter of the windows' hashes move, each with the words of its own window alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import written
from parlance.llm.native import alnum_words, covered

WINDOW = 13
#: Windows that are broadcast at most, some 200 bytes each.
BROADCAST_WINDOWS = 500_000
#: With more, bits of a filter of window hashes that positions pass before they move; a row of its broadcast table holds 64.
FILTER_BITS = 1 << 25


def _hash(h: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(h, at + j) for j in range(n)))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    words = rows.select(*keep, alnum_words(F.col("text")).alias("words"))
    return words.select(*keep, "words", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """len, hash, window and the items that have it. Items without words, or with a null id or text, have no windows."""
    items = _hashed(benchmark.where("item_id is not null"), "item_id").where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))
    at = items.select("item_id", "words", "h", F.least("n", F.lit(WINDOW)).alias("len"), F.explode(starts).alias("at"))
    code = F.coalesce(*(F.when(F.col("len") == k, _hash(F.col("h"), F.col("at"), k)) for k in range(1, WINDOW + 1)))
    rows = at.select(F.col("item_id").cast("string").alias("item_id"), "len", code.alias("hash"), F.expr("slice(words, at + 1, len)").alias("window"))
    return rows.groupBy("len", "hash", "window").agg(F.collect_set("item_id").alias("items"))


def _passing(probe: DataFrame, windows: DataFrame) -> DataFrame:
    """The markers, and the places whose hash may be a window's, with the window's words instead of the text's."""
    place = F.pmod(F.xxhash64("len", "hash"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bits = windows.select(word.alias("__word"), bit.alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))  # FILTER_BITS / 64 rows at most
    near = probe.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    near = near.where((F.col("at") < 0) | (F.col("__bits").bitwiseAND(bit) != 0))
    return near.select("doc_id", "key", "n", "at", "len", "hash", F.when(F.col("at") >= 0, F.expr("slice(words, at + 1, len)")).alias("window"))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, copies, n_words, spans (at, len) and items of each distinct (doc_id, text)."""
    windows = item_windows(benchmark).alias("b")
    sizes = windows.groupBy("len").count().collect()  # 13 rows at most
    lens = sorted(r["len"] for r in sizes)
    small = sum(r["count"] for r in sizes) <= broadcast_windows
    d = _hashed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key")), "doc_id", "key")
    last = F.col("n") - (lens[0] if lens else 1 << 30)
    d = d.select("doc_id", "key", "words", "n", "h", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("at"))
    code = lambda k: F.when((F.col("at") >= 0) & (F.col("at") + k <= F.col("n")), _hash(F.col("h"), F.col("at"), k))
    if len(lens) <= 1:
        probe = d.select("doc_id", "key", "words", "n", "at", F.lit(lens[0] if lens else 0).alias("len"), code(lens[0] if lens else 1).alias("hash"))
    else:
        each = F.inline(F.array(*(F.struct(F.lit(k).alias("len"), code(k).alias("hash")) for k in lens)))
        probe = d.select("doc_id", "key", "words", "n", "at", each)
        probe = probe.where((F.col("at") < 0) & (F.col("len") == lens[0]) | (F.col("hash").isNotNull()))
    if small:
        same = "p.len = b.len and p.hash = b.hash and slice(p.words, greatest(p.at + 1, 1), p.len) = b.window"
        found = probe.alias("p").join(F.broadcast(windows), F.expr(same), "left")
    else:
        same = "p.len = b.len and p.hash = b.hash and p.window = b.window"
        found = _passing(probe, windows).alias("p").join(windows, F.expr(same), "left")
    found = found.where("p.at < 0 or b.hash is not null")
    place = F.when(F.col("p.at") >= 0, F.struct(F.col("p.at").alias("at"), F.col("p.len").alias("len")))
    return found.groupBy("p.doc_id", "p.key", "p.n").agg(
        F.count_if(F.col("p.at") < 0).alias("copies"),
        F.collect_set(place).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("b.items"))).alias("items"),
    )


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings) and contaminated, for each row of docs.

    Null and empty texts have no words and no hits; repeated rows return as often as
    they stand; an empty benchmark hits nothing.
    """
    rows = hits(docs, benchmark, broadcast_windows).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"))
    return out.withColumn("contaminated", _contaminated())


def decontaminate(docs: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """docs without its contaminated documents or, with spans=True, all documents without the hit words.

    All columns stay. Rows are told apart by doc_id and text; texts without hits stay as they are.
    Removing spans leaves what stands between words.
    """
    found = hits(docs, benchmark)
    if not spans:
        bad = found.select("doc_id", "key", F.col("n").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit")).where(_contaminated())
        bad = written(bad.select("doc_id", "key"), "contaminated")  # its size is known then, and texts stay in place if it is small
        return docs.alias("d").join(bad.alias("b"), F.expr("d.doc_id <=> b.doc_id and xxhash64(d.text) = b.key"), "left_anti")
    some = written(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans")), "contaminated")
    rows = docs.alias("d").join(some, F.expr("d.doc_id <=> __id and xxhash64(d.text) = __key"), "left")
    # pieces alternate between words and what parts them, so that a piece's word number is half its place
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    cut = F.expr(rf"""
        array_join(transform(array(regexp_extract_all(d.text, r'({word}+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)', 1)), p ->
          filter(p, (x, i) -> not (x rlike r'^{word}') or not exists(__spans, s ->
            (i - if(p[0] rlike r'^{word}', 0, 1)) div 2 >= s.at and (i - if(p[0] rlike r'^{word}', 0, 1)) div 2 < s.at + s.len)))[0], '')""")
    return rows.select(*(F.when(F.col("__spans").isNull(), F.col("d.text")).otherwise(cut).alias(c) if c == "text" else F.col(f"d.{c}") for c in docs.columns))
