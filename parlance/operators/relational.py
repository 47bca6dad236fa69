"""Joins, set operations, dedup and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that is broadcast at most; its size is checked first.
BROADCAST_ROWS = 100_000


def small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast dim if it has at most so many rows; else Spark chooses the join."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`: a partial aggregate, so that a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *(F.col(c).alias(f"__{c}") for c in rest))).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__row.__{c}").alias(c) for c in rest))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *(F.col(c).alias(f"__{c}") for c in rest))).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__row.__{c}").alias(c) for c in rest))


def lookup(fact: DataFrame, dim: DataFrame, keys: list[str], default: dict[str, object]) -> DataFrame:
    """fact with the dimension's columns, and defaults where it has no row."""
    out = fact.join(small(dim), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose key isn't done: what a resumed run still has to do."""
    return todo.join(done.select(*keys), keys, "left_anti")


def upsert(search: DataFrame, existing: DataFrame, keys: list[str], refresh: list[str], fill: list[str], keep_orphans: bool = False) -> DataFrame:
    """Search rows over existing ones: `refresh` columns take the new value if it isn't empty, `fill` columns only where none was.

    Other columns of an existing row stay. Existing rows that the search lacks go, unless keep_orphans.
    """
    full = lambda c: F.when(c == "", None).otherwise(c)
    new, old = search.alias("n"), existing.alias("o")
    on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys]
    joined = new.join(old, on, "full" if keep_orphans else "left")
    out = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    out += [F.coalesce(full(F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c) for c in refresh]
    out += [F.coalesce(full(F.col(f"o.{c}")), F.col(f"n.{c}")).alias(c) for c in fill]
    rest = [c for c in existing.columns if c not in keys + refresh + fill]
    return joined.select(*out, *(F.col(f"o.{c}").alias(c) for c in rest))


def reconcile(listed: DataFrame, available: DataFrame, done: list[DataFrame], known: DataFrame, key: str) -> DataFrame:
    """The action for each id of any side: done, keep, new or missing.

    One aggregate over flagged unions replaces a chain of full joins.
    """
    sides = [(listed, "listed"), (available, "available"), *((d, "done") for d in done), (known, "known")]
    flagged = None
    for df, side in sides:
        part = df.select(F.col(key), F.lit(side).alias("side"))
        flagged = part if flagged is None else flagged.unionByName(part)
    has = lambda s: F.max((F.col("side") == s).cast("int")).alias(s)
    out = flagged.groupBy(key).agg(has("listed"), has("available"), has("done"), has("known"))
    valid = (F.col("listed") == 1) & (F.col("available") == 1)
    return out.withColumn("action", F.when(F.col("done") == 1, "done").when(valid & (F.col("known") == 1), "keep").when(valid, "new").otherwise("missing"))


def best_overlap(segments: DataFrame, turns: DataFrame, key: str, segment: list[str], unknown: str = "UNKNOWN", bucket: float | None = None) -> DataFrame:
    """Each segment with the label of the one turn that it overlaps most; the earliest of equals; `unknown` without any.

    segments: key, start, end and the columns `segment` that name a row; turns: key, start, end, label.
    With `bucket`, both sides are dealt into time buckets of that width, so that a key
    with very many turns is spread; a pair meets in the later of their first buckets alone.
    """
    s = segments.select(key, *segment, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    t = turns.select(F.col(key).alias("t_key"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), "label")
    hit = (F.col("s_start") < F.col("t_end")) & (F.col("t_start") < F.col("s_end"))
    if bucket:
        first = lambda c: F.floor(F.col(c) / bucket)
        span = lambda a, b: F.explode(F.sequence(first(a), F.greatest(first(a), first(b))))
        s = s.withColumn("s_bucket", span("s_start", "s_end"))
        t = t.withColumn("t_bucket", span("t_start", "t_end"))
        hit = hit & (F.col("s_bucket") == F.col("t_bucket")) & (F.col("s_bucket") == F.greatest(first("s_start"), first("t_start")))
    overlap = F.least("s_end", "t_end") - F.greatest("s_start", "t_start")
    pick = F.when(F.col("t_key").isNotNull(), F.struct((-overlap).alias("neg"), "t_start", "t_end", "label"))
    best = s.join(t, (F.col(key) == F.col("t_key")) & hit, "left").groupBy(key, *segment).agg(F.min(pick).alias("best"))
    return best.select(key, *segment, F.coalesce(F.col("best.label"), F.lit(unknown)).alias("label"), F.coalesce(-F.col("best.neg"), F.lit(0.0)).alias("overlap"))


def replace_lines(lines: DataFrame, changes: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """Lines with those of `changes` (key, at, text, new array) replaced where the text is still the same, numbered anew."""
    c = changes.select(key, at, F.col(text).alias("__old"), "new")
    joined = lines.join(c, [key, at], "left")
    new = F.when(F.col("new").isNotNull() & (F.col("__old") == F.col(text)), F.col("new")).otherwise(F.array(F.col(text)))
    grouped = joined.select(key, at, new.alias("new")).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at, "new"))), lambda x: x["new"])).alias("all"))
    return grouped.select(key, F.posexplode("all").alias(at, text))


def common_ids(*tables: DataFrame) -> DataFrame:
    """Ids that all tables have."""
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.join(t, out.columns, "left_semi")
    return out


def counted(df: DataFrame, column: str, known: list, name: str = "n") -> DataFrame:
    """Rows by value, with 0 for known values that don't occur; unknown values count too."""
    every = df.sparkSession.createDataFrame([(v, 0) for v in known], f"{column} {df.schema[column].dataType.simpleString()}, {name} long")
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).unionByName(every).groupBy(column).agg(F.sum(name).alias(name))


def first_match(*rules: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def assign(fact: DataFrame, mapping: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """fact with the value of the last mapping row of its key; rows without one, or with an empty one, go."""
    last = last_wins(mapping.select(key, value, *(c for c in order if c not in (key, value))), [key], order).select(key, value)
    return fact.join(small(last.where(F.coalesce(F.col(value), F.lit("")) != "")), key)


def match_replies(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """Batch rows (batch_id, rel_idx) with the reply rows (batch_id, idx, valence, modality) of their place; of several the first valid one by `line`."""
    one = keep_first(replies, ["batch_id", "idx"], ["line"])
    return batched.join(one.withColumnRenamed("idx", "rel_idx").drop("line"), ["batch_id", "rel_idx"])
