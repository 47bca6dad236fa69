"""Contingency, correlation, rank tests and a mixed model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.tails import chi2_pvalue, pearson_pvalue


def contingency(x: Column, y: Column, name: str) -> list[Column]:
    """The four cells of x against y, as aggregates."""
    x, y = F.coalesce(x, F.lit(False)), F.coalesce(y, F.lit(False))
    return [F.count_if(a & b).alias(f"{name}_{cell}") for cell, a, b in (("n11", x, y), ("n10", x, ~y), ("n01", ~x, y), ("n00", ~x, ~y))]


def phi(name: str) -> Column:
    """Phi coefficient of the cells, to four digits; null if a margin is empty."""
    n11, n10, n01, n00 = (F.col(f"{name}_{c}").cast("double") for c in ("n11", "n10", "n01", "n00"))
    return F.round(F.try_divide(n11 * n00 - n10 * n01, F.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))), 4)


def phi_table(df: DataFrame, by: str, pairs: dict[str, tuple[Column, Column]], least: int = 10) -> DataFrame:
    """Phi of each pair by group with at least `least` rows, and of all rows (group null), in one pass."""
    flags = {f"__{n}_{i}": c for n, xy in pairs.items() for i, c in enumerate(xy)}
    rows = df.select(by, *(c.alias(n) for n, c in flags.items()))
    cells = [c for n in pairs for c in contingency(F.col(f"__{n}_0"), F.col(f"__{n}_1"), n)]
    out = rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.grouping(by).alias("pooled"), *cells)
    out = out.where((F.col("pooled") == 1) | (F.col("n") >= least))
    return out.select(by, F.col("pooled").cast("int").alias("pooled"), "n", *(F.col(f"{p}_n11") for p in pairs), *(phi(p).alias(f"{p}_phi") for p in pairs))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null instead of a division by zero."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def with_pvalue(df: DataFrame, r: str, n: str, name: str, digits: int = 6) -> DataFrame:
    """df (one row for each group) with the two-sided p-value of a correlation."""
    return df.withColumn(name, F.round(pearson_pvalue(F.col(r), F.col(n)), digits))


def average_rank(value: Column | str) -> Column:
    """Rank over all rows with ties averaged. For group-level results: one row a group."""
    w = W.orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(value)) - 1) / 2


def ranked(df: DataFrame, value: str) -> DataFrame:
    """df with `rank`, ties averaged, by way of the counts of distinct values: rows of a hot value meet no further than their count."""
    from parlance.operators.ordered import running_total

    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_total(n, F.col("__n"), [value], "__upto")
    return df.join(upto.select(value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias("rank"), F.col("__n").alias("ties")), value)


def kruskal(df: DataFrame, group: str, value: str, least: int = 2) -> DataFrame:
    """Kruskal-Wallis H with tie correction over groups of at least `least` values, degrees of freedom and p-value; one row."""
    rows = df.where(F.col(value).isNotNull()).select(group, value)
    good = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= least).select(group)
    r = ranked(rows.join(good, group, "left_semi"), value)
    sums = r.groupBy(group).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("k"))
    part = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("ss"), F.sum("k").cast("double").alias("n"), F.count(F.lit(1)).alias("groups"))
    ties = r.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0)).alias("ties"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = part.join(F.broadcast(ties)).where("groups >= 2").select(h.alias("h"), (F.col("groups") - 1).alias("df"))  # one row each
    return out.select(F.round("h", 4).alias("kruskal_h"), "df", F.round(chi2_pvalue(F.col("h"), F.col("df")), 4).alias("p"))


def _profile(sums: pd.DataFrame, features: list[str], least: int) -> pd.DataFrame:
    """Random-intercept model by profile likelihood (REML) over the ratio of the two variances, from the sums of each group; no constant column."""
    cols = ["n", "log_likelihood", "aic", "random_effects_var", "residual_var", *features]
    size, p = sums["size"].to_numpy(float), len(features)
    n = int(size.sum())
    if n < least:
        return pd.DataFrame([[n] + [None] * (len(cols) - 1)], columns=cols)
    sx, sy = sums[[f"x{i}" for i in range(p)]].to_numpy(float), sums["y"].to_numpy(float)
    total = sums.sum(numeric_only=True)
    xx = np.array([[total[f"x{min(i, j)}x{max(i, j)}"] for j in range(p)] for i in range(p)])
    xy, yy = np.array([total[f"x{i}y"] for i in range(p)]), total["yy"]

    def fit(ratio: float) -> tuple:
        # the inverse of I + ratio * Z Z' takes ratio / (1 + ratio * size) of each group's sums off
        w = ratio / (1 + ratio * size)
        a = xx - sx.T @ (sx * w[:, None])
        b = xy - sx.T @ (sy * w)
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        q = yy - (sy * sy * w).sum() - beta @ b
        var = max(q / (n - p), 1e-300)
        det = np.log1p(ratio * size).sum()
        ll = -0.5 * ((n - p) * np.log(2 * np.pi * var) + (n - p) + det + np.linalg.slogdet(a)[1])
        return ll, beta, var

    lo, hi = -12.0, 8.0
    grid = np.linspace(lo, hi, 81)
    best = max(grid, key=lambda z: fit(np.exp(z))[0])
    a, b = best - 0.25, best + 0.25
    for _ in range(60):
        c, d = a + 0.382 * (b - a), a + 0.618 * (b - a)
        a, b = (a, d) if fit(np.exp(c))[0] > fit(np.exp(d))[0] else (c, b)
    ratio = np.exp((a + b) / 2)
    if fit(0.0)[0] >= fit(ratio)[0]:
        ratio = 0.0
    ll, beta, var = fit(ratio)
    return pd.DataFrame([[n, ll, -2 * ll + 2 * (p + 2), ratio * var, var, *beta]], columns=cols)


def mixed_model(df: DataFrame, features: list[str], target: str, group: str, least: int = 10) -> DataFrame:
    """Standardised features with a random intercept by group.

    Rows become sums by partial aggregation, which are all that the likelihood needs: one task
    gets a row a group. Rows with nulls teach nothing; fewer than `least` full rows give nulls.
    """
    schema = "n long, log_likelihood double, aic double, random_effects_var double, residual_var double, " + ", ".join(f"`{f}` double" for f in features)
    x = [f"x{i}" for i in range(len(features))]
    rows = df.select(*(F.col(f).cast("double").alias(k) for k, f in zip(x, features)), F.col(target).cast("double").alias("y"), F.col(group).cast("string").alias("g")).dropna()
    scale = rows.agg(*(F.avg(k).alias(f"{k}_mean") for k in x), *(F.nullif(F.stddev_pop(k), F.lit(0.0)).alias(f"{k}_sd") for k in x))  # one row
    z = rows.join(F.broadcast(scale)).select("g", "y", *(((F.col(k) - F.col(f"{k}_mean")) / F.coalesce(f"{k}_sd", F.lit(1.0))).alias(k) for k in x))
    products = {f"{a}{b}": F.col(a) * F.col(b) for i, a in enumerate(x) for b in x[i:]} | {f"{a}y": F.col(a) * F.col("y") for a in x} | {"yy": F.col("y") * F.col("y")}
    sums = z.groupBy("g").agg(F.count(F.lit(1)).alias("size"), *(F.sum(k).alias(k) for k in [*x, "y"]), *(F.sum(v).alias(k) for k, v in products.items()))
    return sums.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: _profile(pdf, features, least), schema)
