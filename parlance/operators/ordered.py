"""Operators over an order: running totals, samples, batches, runs, gaps and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import let
from parlance.session import written


def running_total(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """df with the sum of `value` over all rows up to each, in a total order, without bringing all rows together.

    Rows are dealt out by range; totals of the ranges (one row each) give every range its start.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that both readers see one dealing out, also when executors are lost: another one would draw other range bounds
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).withColumn("__value", value), "running-total")
    totals = dealt.groupBy("__part").agg(F.sum("__value").alias("__sum"))  # one row a partition
    before = totals.alias("a").join(F.broadcast(totals.alias("b")), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.__sum"), F.lit(0)).alias("__before"))
    within = F.sum("__value").over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__value", "__before", "__within")


def byte_budget(df: DataFrame, size: str, order: list[str], limit: int) -> DataFrame:
    """The longest prefix in order whose sizes sum to at most `limit`."""
    return running_total(df, F.col(size), order, "__total").where(F.col("__total") <= limit).drop("__total")


def _seeded(seed: int, keys: list[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified_sample(df: DataFrame, stratum: str, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """max(1, floor(n * fraction)) rows of each stratum, those of the least seeded hash; a null stratum is one too.

    Before the sort, rows whose hash stands over twelve standard deviations above the
    fraction are dropped, so that a large stratum sends its sample and a margin rather than all its rows.
    A stratum with fewer rows within the margin than wanted (its rows share keys, and so hashes) has all its rows ranked.
    """
    h = _seeded(seed, keys)
    # the leading 32 bits of the hash as a share of all hashes
    place = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    own = F.count(F.lit(1)).alias("__n")
    want = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))
    margin = want / F.col("__n") + 12 * F.sqrt(want.cast("double")) / F.col("__n") + F.lit(40.0) / F.col("__n")
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(own).withColumns({"__want": want, "__margin": margin})
    rows = df.withColumns({"__h": h, "__place": place})
    near = F.col("__place") <= F.col("__margin")
    met = rows.join(F.broadcast(sizes), F.col(stratum).eqNullSafe(F.col("__s")))
    within = met.where(near).groupBy(F.col("__s").alias("__t")).agg(F.count(F.lit(1)).alias("__near"))
    limits = sizes.join(within, F.col("__s").eqNullSafe(F.col("__t")), "left")
    limits = limits.select("__s", "__want", F.when(F.coalesce("__near", F.lit(0)) >= F.col("__want"), F.col("__margin")).otherwise(1.0).alias("__margin"))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy("__h", *keys))
    near_enough = rows.join(F.broadcast(limits), F.col(stratum).eqNullSafe(F.col("__s"))).where(near)
    return near_enough.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__want")).select(*df.columns)


def per_group_cap(df: DataFrame, group: str, keys: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """k rows of each group by a seeded hash; k = 0 keeps all. The rank limit goes below the shuffle."""
    if not k:
        return df
    rank = F.row_number().over(W.partitionBy(group).orderBy("__h", *keys))
    return df.withColumn("__h", _seeded(seed, keys)).withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__h", "__rank")


def head_k(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def tail_k(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    return head_k(df, group, [F.col(c).desc() for c in order], k)


def stride_sample(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """Rows int(i * n / k) for i below k of groups with over k rows; all rows of the others."""
    own = W.partitionBy(group)
    rows = df.withColumn("__i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(own))
    # i is taken if some j below k has floor(j * n / k) = i
    taken = F.floor(F.ceil(F.col("__i") * k / F.col("__n")) * F.col("__n") / k) == F.col("__i")
    return rows.where((F.col("__n") <= k) | taken & (F.ceil(F.col("__i") * k / F.col("__n")) < k)).drop("__i", "__n")


def batches(df: DataFrame, order: list[str], size: int, name: str = "batch_id") -> DataFrame:
    """Rows in order, `size` to a batch, with their place in it."""
    rows = running_total(df, F.lit(1).cast("long"), order, "__row").withColumn("__row", F.col("__row") - 1)
    return rows.withColumn(name, F.floor(F.col("__row") / size).cast("long")).withColumn("rel_idx", (F.col("__row") % size).cast("int")).drop("__row")


def runs(df: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """df with the number of its run of equal labels, from 0."""
    w = W.partitionBy(group).orderBy(order)
    turn = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    turn = F.when(F.lag(F.lit(1)).over(w).isNull(), 0).otherwise(turn)
    return df.withColumn("__turn", turn).withColumn("run", F.sum("__turn").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__turn")


def turns_text(df: DataFrame, group: str, order: str, label: str, text: str) -> DataFrame:
    """One row for each run of a speaker: its label and its texts joined in order."""
    rows = runs(df, group, order, label).groupBy(group, "run").agg(F.first(label).alias(label), F.array_sort(F.collect_list(F.struct(order, text))).alias("__rows"))
    return rows.select(group, F.col("run").cast("long").alias("run"), label, F.array_join(F.transform("__rows", lambda x: x[text]), " ").alias(text), F.size("__rows").alias("n_segments"))


def gaps(df: DataFrame, group: str, start: str, end: str, order: list[str], gap_over: float = 0.5, overlap_over: float = 0.1) -> DataFrame:
    """df with the gap to the segment before it and the overlap with it, 0 unless over the limits."""
    before = F.lag(end).over(W.partitionBy(group).orderBy(start, *order))
    return df.withColumn("gap", F.when(F.col(start) - before > gap_over, F.col(start) - before).otherwise(0.0)).withColumn("overlap", F.when(before - F.col(start) > overlap_over, before - F.col(start)).otherwise(0.0))


def dedup_consecutive(lines: Column) -> Column:
    """An array of lines without those equal to the line before."""
    return let(lines, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


# Fixed values of the line fold: abbreviations that a line may end in, words that never end a sentence, and the patterns.
ABBREVIATIONS = [
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "ave.", "blvd.", "dept.", "co.", "inc.", "ltd.",
    "corp.", "gen.", "sgt.", "capt.", "lt.", "gov.", "sen.", "rep.", "hon.", "rev.", "fr.", "jr.", "sr.", "esq.",
    "etc.", "vs.", "a.m.", "p.m.", "u.s.", "u.k.", "e.u.",
]
FUNCTION_WORDS = [
    "the", "a", "an", "to", "of", "in", "on", "at", "for", "with", "by", "that", "this", "these", "those", "which",
    "who", "whom", "whose", "and", "or", "but", "nor", "yet", "so", "if", "as", "than", "from", "into", "through",
    "during", "before", "after", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do",
    "does", "did", "will", "would", "can", "could", "shall", "should", "may", "might",
]
_ENDS = r"""[.!?…]['"’”)]?$"""
_CONTINUES = r"""^[a-z"'‘“(]"""


def continues(line: Column, following: Column, strict: bool = False) -> Column:
    """Whether the next line goes on with this one.

    Without strict, a line that ends in the letters of an abbreviation is no
    boundary ("have." ends in "ave."); strict asks for the abbreviation as a word of its own.
    """
    ends = "|".join(a.replace(".", r"\.") for a in dict.fromkeys(ABBREVIATIONS))
    abbreviated = F.regexp_like(F.lower(line), F.lit(rf"(?:^|\s)(?:{ends})$" if strict else rf"(?:{ends})$"))
    boundary = ~abbreviated & F.regexp_like(line, F.lit(_ENDS))
    lower = F.regexp_like(F.ltrim(following), F.lit(_CONTINUES))
    last = F.regexp_replace(F.lower(F.regexp_extract(line, r"(\S+)\s*$", 1)), r"""^[.,!?;:'"()\[\]-]+|[.,!?;:'"()\[\]-]+$""", "")
    joins = F.regexp_like(line, F.lit(r"(,|[-–—]+)$")) | last.isin(FUNCTION_WORDS) | lower
    short = (F.size(F.split(F.trim(line), r"\s+")) <= 3) & ~F.regexp_like(line, F.lit(r"[.!?…]$"))
    return F.when(boundary & ~lower, False).otherwise(joins | short)


def folded(lines: Column, strict: bool = False) -> Column:
    """An ordered array of lines with those joined that go on with the line before, as joined so far; blank lines go."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, line: Column) -> Column:
        glue = F.when(F.regexp_like(acc["now"], F.lit("[-–—]$")), F.concat(acc["now"], line)).otherwise(F.concat_ws(" ", acc["now"], line))
        more = acc["now"].isNotNull() & continues(acc["now"], line, strict)
        done = F.when(more | acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        return F.struct(done.alias("done"), F.when(more, glue).otherwise(line).alias("now"))

    return F.aggregate(kept, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """df in a seeded order that is the same on every engine and at every partitioning."""
    return df.withColumn("__h", _seeded(seed, keys)).orderBy("__h", *keys).drop("__h")


def spread_sample(df: DataFrame, group: str, order: list[str], k: int = 25) -> DataFrame:
    """Rows 0, s, 2s, ... of each group with s = max(1, n div k), k at most."""
    own = W.partitionBy(group)
    rows = df.withColumn("__i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__s", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(own) / k)))
    return rows.where((F.col("__i") % F.col("__s") == 0) & (F.col("__i") < F.col("__s") * k)).drop("__i", "__s")
