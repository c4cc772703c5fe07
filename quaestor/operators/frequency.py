"""Frequency tables of one variable and of groups of binary ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.exprs import col, number, wilson


def frequency(df: DataFrame, name: str, z: float = 1.96, most: int | None = None) -> DataFrame:
    """(value, n, pct, pct_all, ci_low, ci_high, cum_pct, cum_rounded), commonest first, of equals the smaller value.

    ``pct``: of rows with a value, 1 digit; ``pct_all``: of all rows; ``cum_pct``: of unrounded, ``cum_rounded``: of rounded
    shares, 100 at most. Values are trimmed; 0/1 variables read Oui/Non. ``most``: only so many values. No value: no rows.
    """
    c = F.trim(col(name).cast("string"))
    counts = df.groupBy(c.alias("value")).agg(F.count("*").alias("n"))
    # The totals are one row; the ranking works on distinct values alone.
    totals = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("valid"), F.min(F.col("value").isNull() | F.col("value").isin("0", "1", "0.0", "1.0")).alias("flag"))
    rows = counts.where("value is not null").join(F.broadcast(totals))
    order = Window.orderBy(F.desc("n"), "value")
    if most is not None:
        rows = rows.orderBy(F.desc("n"), "value").limit(most)
    low, high = wilson(F.col("n"), F.col("valid"), z)
    pct = 100.0 * F.col("n") / F.col("valid")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    shown = F.when(F.col("flag"), F.when(F.col("value").isin("1", "1.0"), "Oui").otherwise("Non")).otherwise(F.col("value"))
    return rows.select(
        shown.alias("value"), "n", F.round(pct, 1).alias("pct"), F.round(100.0 * F.col("n") / F.col("all"), 1).alias("pct_all"), F.round(low, 1).alias("ci_low"), F.round(high, 1).alias("ci_high"),
        F.round(F.sum(pct).over(running), 4).alias("cum_pct"), F.round(F.least(F.lit(100.0), F.sum(F.round(pct, 1)).over(running)), 1).alias("cum_rounded"),
    )


def concentration(df: DataFrame, name: str) -> DataFrame:
    """(k, entropy, entropy_max, entropy_norm, herfindahl, mode, mode_pct) of a variable: one row; nulls are left out."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    out = counts.join(F.broadcast(total)).agg(
        F.count("*").alias("k"), F.round(F.sum(-p * F.log2(p + 1e-10)), 3).alias("entropy"), F.round(F.log2(F.count("*").cast("double")), 3).alias("entropy_max"), F.round(F.sum(p * p), 3).alias("herfindahl"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.round(100.0 * F.max("n") / F.first("total"), 1).alias("mode_pct"),
    )
    return out.where("k > 0").withColumn("entropy_norm", F.round(F.col("entropy") / F.nullif(F.col("entropy_max"), F.lit(0.0)), 3))


def binary_group(df: DataFrame, names: list[str]) -> DataFrame:
    """(label, n_yes, pct, ci_low, ci_high), least first: the sum of each 0/1 column over all rows, null as 0."""
    row = lambda n: F.struct(F.lit(n.rpartition("/")[2]).alias("label"), F.sum(F.coalesce(number(col(n)), F.lit(0.0))).cast("long").alias("n_yes"), F.count("*").alias("total"))
    out = df.agg(F.array(*map(row, names)).alias("x")).select(F.inline("x"))
    low, high = wilson(F.col("n_yes"), F.col("total"))
    return out.select("label", "n_yes", F.round(100.0 * F.col("n_yes") / F.nullif(F.col("total"), F.lit(0)), 1).alias("pct"), F.round(low, 1).alias("ci_low"), F.round(high, 1).alias("ci_high")).orderBy("n_yes", "label")


def binary_summary(df: DataFrame, name: str) -> DataFrame:
    """(value, n, pct, dominant): of a two-valued variable; its prevalence is the dominant value's share, not that of 1."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    best = counts.agg(F.sum("n").alias("total"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("best"))
    return counts.join(F.broadcast(best)).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"), (F.col("value") == F.col("best")).alias("dominant"))


def status_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(col(name).alias("value")).agg(F.count("*").alias("n"))
