"""Quality rules with thresholds that adapt to language and source.

Each text gets five measures in one pass inside the JVM. Thresholds come from
quantile sketches: log-linear histograms of relative error 1/32, whose counts add
up, so that sketches of tasks merge into those of sources, sources into languages
and languages into the whole. No threshold is a fixed cutoff: word length is fenced by
quartiles; symbols, repeated lines and repeated words, which most texts have none of, by a
tail quantile and a margin that comes from the sketch too. A source with few texts takes its
language's thresholds. The thresholds join the texts, and a text beyond one goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import written
from parlance.llm.native import covered, let, space_words

#: Words of a window whose return counts as a repetition.
WINDOW = 8
#: A group with fewer texts takes the thresholds of the group above it.
LEAST_TEXTS = 100
#: Word length: the third quartile plus so many interquartile ranges.
FENCE = 6
#: The others, in parts of 10,000: this percentile, plus half of it, or half of the 5th percentile of what isn't 0 if that is more.
TAILS = {"symbols": 85, "dup_lines": 99, "repeats": 99}
RATES = [*TAILS, "word_len"]
#: Sub-buckets of a power of two.
GRAIN_BITS = 5


def _repeat_windows(words: Column) -> Column:
    """Words inside windows of WINDOW words that the text has twice or more."""

    def from_hashes(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))

    def places_of_twins(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(
            by_hash,
            lambda s: F.transform(
                F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                lambda x: F.struct(x["at"].alias("at"), F.lit(WINDOW).alias("len")),
            ),
        )

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(places_of_twins(w)))

    # get(s, -1) is null, and null or false is null: the filter drops it, as it should
    long_enough = F.size(words) >= WINDOW
    return F.when(long_enough, let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(from_hashes(h), count))).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns, doc_id, lang, source and the measures of each whole text; a null text has no words and no lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    base = docs.select(*keep, "doc_id", "lang", "source", text.alias("text"), space_words(F.col("text")).alias("words"), lines.alias("lines"))
    return base.select(
        *keep,
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_windows(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _rates() -> dict[str, Column]:
    """Measures as whole numbers: parts of 10,000, or hundredths of a character."""
    part = lambda a, b: F.floor(F.col(a) * 10000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "word_len": F.floor(F.col("word_chars") * 100 / F.greatest(F.col("n_words"), F.lit(1))).cast("long")}


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket: exact below 2 ** (GRAIN_BITS + 1), else the leading bits."""
    drop = F.greatest(F.char_length(F.bin(value)) - (GRAIN_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rates: DataFrame) -> DataFrame:
    """level, lang, source, rate, bucket, n. rates: lang, source and one column for each rate.

    Partial aggregation leaves a task at most one row for each group, rate and bucket.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in RATES))).alias("p")
    own = rates.select("lang", "source", pairs).groupBy("lang", "source", F.col("p.rate").alias("rate"), F.col("p.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(None).cast("string")
    levels = [own.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")]
    for level, lang in ((1, F.col("lang")), (2, null)):
        levels.append(own.groupBy(lang.alias("lang"), "rate", "bucket").agg(F.sum("n").alias("n")).select(F.lit(level).alias("level"), "lang", null.alias("source"), "rate", "bucket", "n"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def thresholds(sketch: DataFrame) -> DataFrame:
    """level, lang, source, n and the highest allowed value of each rate, from the group's own sketch."""
    group = ["level", "lang", "source", "rate"]
    upto = F.sum("n").over(W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    none = F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(W.partitionBy(*group))
    rows = sketch.select(*group, "bucket", upto.alias("upto"), F.sum("n").over(W.partitionBy(*group)).alias("all"), none.alias("none"))
    at = lambda k: F.min(F.when(F.col("upto") * 100 >= F.col("all") * k, F.col("bucket")))
    some = F.min(F.when((F.col("bucket") > 0) & ((F.col("upto") - F.col("none")) * 20 >= F.col("all") - F.col("none")), F.col("bucket")))
    tail = F.element_at(F.create_map(*(F.lit(x) for kv in TAILS.items() for x in kv)), F.col("rate"))
    q = rows.withColumn("tail", tail).groupBy(*group).agg(at(25).alias("q1"), at(75).alias("q3"), at(F.col("tail")).alias("t"), some.alias("some"), F.max("all").alias("n"))
    margin = F.shiftright(F.greatest("t", F.coalesce("some", F.lit(0))), 1)
    spread = F.greatest(F.col("q3") - F.col("q1"), F.shiftright("q3", GRAIN_BITS))  # no less than the sketch resolves
    high = F.when(F.col("rate") == "word_len", F.col("q3") + FENCE * spread).otherwise(F.col("t") + margin)
    return q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("rate") == r, high)).alias(f"max_{r}") for r in RATES))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and the limit of each rate, for each source.

    A source of LEAST_TEXTS texts has its own thresholds, but none under half of its
    language's (for word length: under its language's), so that a source of copies isn't judged by one
    text. A smaller one has its language's. Languages stand to the whole as sources do to languages.
    """
    own = thresholds(sketch)
    level = lambda k: own.where(F.col("level") == k).alias("abc"[k])
    rows = level(0).join(level(1), F.expr("a.lang <=> b.lang"), "left").join(level(2), F.lit(True), "left")  # c has one row

    def settled(side: str, r: str, above: Column) -> Column:
        least = above if r == "word_len" else F.shiftright(above, 1)
        return F.when(F.col(f"{side}.n") >= LEAST_TEXTS, F.greatest(f"{side}.max_{r}", least)).otherwise(above)

    return rows.select("a.lang", "a.source", *(settled("a", r, settled("b", r, F.col(f"c.max_{r}"))).alias(f"max_{r}") for r in RATES))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _with_rates(docs: DataFrame, *keep: str) -> DataFrame:
    return measures(docs, *keep).withColumns({"base_failed": base_failed()} | _rates())


def _judged() -> Column:
    """Whether a row m of measures, joined with its limits l, is kept."""
    ok = ~F.col("m.base_failed")
    for r in RATES:
        ok = ok & F.coalesce(bucket(F.col(f"m.{r}")) <= F.col(f"l.max_{r}"), F.lit(True))
    return ok


_LIKE = "m.lang <=> l.lang and m.source <=> l.source"


def verdicts(docs: DataFrame) -> DataFrame:
    """The measures, base_failed and kept of each row.

    Thresholds are learned from all rows that the base rule passes. Null languages
    and sources are groups of their own; repeated rows count and return as often as
    they stand; a null doc_id stays null; an empty table gives none. The measures are written once, then read by sketches and join alike.
    """
    m = written(_with_rates(docs), "quality-measures")
    limit = limits(sketches(m.where(~F.col("base_failed"))))
    out = m.alias("m").join(limit.alias("l"), F.expr(_LIKE), "left")
    return out.select("m.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", _judged().alias("kept"), *(f"m.{r}" for r in RATES))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they were.

    Each row is judged by its own text, whatever its doc_id: the limits are learned in
    one pass and written, the measures are taken again in the pass that filters.
    """
    m = _with_rates(docs)
    limit = written(limits(sketches(m.where(~F.col("base_failed")))), "quality-limits")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "lang", "source", "text")
    rows = _with_rates(whole, "row")
    return rows.alias("m").join(limit.alias("l"), F.expr(_LIKE), "left").where(_judged()).select("m.row.*")
