"""Tests between groups: their figures are aggregated on the cluster, their tail probabilities computed on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import stats
from quaestor.functions.exprs import col, number
from quaestor.operators.quantiles import quantiles


#: Ranges of values whose counts are summed apart when ranks are made.
RANGES = 1024


def ranked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``rank``, the average rank of ``name`` among its values; rows without one are dropped.

    Ranks come from counts of distinct values: rows meet the running count of their value by a join, so that no task sorts all.
    """
    x = number(col(name))
    rows = df.withColumn("__x", x).where("__x is not null")
    counts = rows.groupBy("__x").agg(F.count("*").alias("__t"))
    # The running count of distinct values: of each range of values its own, and before it the sums of the ranges.
    lo, hi = counts.agg(F.min("__x"), F.max("__x")).first()
    step = (hi - lo) / RANGES if hi is not None and hi > lo else 1.0
    cut = counts.withColumn("__r", F.least(F.floor((F.col("__x") - F.lit(lo if lo is not None else 0.0)) / step), F.lit(RANGES - 1)))
    sums = cut.groupBy("__r").agg(F.sum("__t").alias("__n"))
    base = sums.select("__r", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum("__t").over(Window.partitionBy("__r").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = cut.withColumn("__own", own).join(F.broadcast(base), "__r").withColumn("__before", F.col("__own") + F.col("__base"))
    ranks = before.select("__x", (F.col("__before") + (F.col("__t") + 1) / 2.0).alias("rank"), "__t")
    return rows.join(ranks, "__x").drop("__x")


def group_figures(df: DataFrame, group: str, value: str, least: int = 1) -> DataFrame:
    """(group, n, mean, median, std, min, max) of groups of ``least`` values or more."""
    x = number(col(value))
    out = df.where(col(group).isNotNull()).groupBy(col(group).cast("string").alias("group")).agg(F.count(x).alias("n"), F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_samp(x), 2).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    middle = quantiles(df.where(col(group).isNotNull()).select(col(group).cast("string").alias("group"), x.alias("x")), ["group"], "x", [0.5])
    out = out.where(F.col("n") >= least).join(middle, "group", "left")
    return out.select("group", "n", "mean", F.round(F.col("q")[0], 2).alias("median"), "std", "min", "max")


def anova(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """(test, statistic, p, groups, n): one row; nulls under two groups of ``least`` values."""
    x = number(col(value))
    found = df.where(col(group).isNotNull()).groupBy(col(group).alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).where(F.col("n") >= least).collect()  # a row for each group
    f, p = stats.anova([(r["n"], r["m"], r["v"]) for r in found]) if len(found) > 1 else (None, None)
    return df.sparkSession.createDataFrame([("ANOVA", round(f, 4) if f is not None else None, p, len(found), sum(r["n"] for r in found))], "test string, statistic double, p double, groups int, n long")


def kruskal(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """As ``anova``, by average ranks, corrected for ties."""
    x = number(col(value))
    big = df.where(col(group).isNotNull() & x.isNotNull()).groupBy(col(group).alias("__g")).count().where(F.col("count") >= least).select("__g")
    rows = ranked(df.join(big, col(group) == F.col("__g")), value)
    found = rows.groupBy("__g").agg(F.count("*").alias("n"), F.sum("rank").alias("s")).collect()
    ties = rows.groupBy("rank").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t"))).first()[0] or 0.0
    h, p = stats.kruskal([(r["n"], r["s"]) for r in found], ties) if len(found) > 1 else (None, None)
    return df.sparkSession.createDataFrame([("Kruskal-Wallis", round(h, 4) if h is not None else None, p, len(found), sum(r["n"] for r in found))], "test string, statistic double, p double, groups int, n long")


def normality(df: DataFrame, name: str, policy: str = "test", most: int = 5000) -> tuple[float | None, bool]:
    """(p, normal). Under 3 values no test; up to ``most`` Shapiro-Wilk; beyond: ``test`` D'Agostino-Pearson, ``normal``, ``other``."""
    x = number(col(name))
    n, skew, kurt = df.agg(F.count(x), F.skewness(x), F.kurtosis(x)).first()
    if n < 3:
        return None, False
    if n <= most:
        p = stats.shapiro([r[0] for r in df.where(x.isNotNull()).select(x).collect()])[1]  # at most ``most`` values
    elif policy == "test":
        p = stats.dagostino(n, skew, kurt)[1]
    else:
        p = 1.0 if policy == "normal" else 0.0
    return p, p >= 0.05


def compare_groups(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """ANOVA where every group of under 5000 values looks normal, else Kruskal-Wallis."""
    names = [r[0] for r in df.where(col(group).isNotNull() & number(col(value)).isNotNull()).groupBy(col(group)).count().where(F.col("count") >= least).collect()]
    fine = all(normality(df.where(col(group) == g), value, policy="other", most=4999)[1] for g in names)
    return (anova if fine else kruskal)(df, group, value, least)


def spearman(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, rho, p, n) of each pair, over rows where both have values; nulls under 3 rows."""
    lines = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = df.where(number(col(a)).isNotNull() & number(col(b)).isNotNull()).select(number(col(a)).alias("a"), number(col(b)).alias("b"))
            r = ranked(ranked(both, "a").withColumnRenamed("rank", "ra").drop("__t"), "b")
            n, rho = r.agg(F.count("*"), F.corr("ra", "rank")).first()
            p = None if n < 3 or rho is None else 0.0 if abs(rho) >= 1 else stats.t_tail(rho * ((n - 2) / (1 - rho * rho)) ** 0.5, n - 2)
            lines.append((a, b, round(rho, 6) if n >= 3 and rho is not None else None, p, n))
    return df.sparkSession.createDataFrame(lines, "a string, b string, rho double, p double, n long")
