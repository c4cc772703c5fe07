"""Exact quantiles in bounded memory: a sketch brackets each one, and only the values within its bracket are counted one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.exprs import col

#: The sketch's rank error is one in ACCURACY; brackets reach MARGIN of the ranks to both sides.
ACCURACY, MARGIN = 10_000, 1e-3


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], few: bool = False) -> DataFrame:
    """(keys..., q): for each group the quantiles of ``value``, interpolated between neighbours, as an array.

    Rows without a value and null keys have no part. ``few``: the groups are few enough to be broadcast. The first pass sketches
    each group; the second adds up the rows below and above each bracket, so that a window orders the bracket's values alone.
    """
    x, by = col(value), [col(k) for k in keys]
    rows = rows.where(x.isNotNull())
    marks = [m for p in probs for m in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    near = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx(x, F.array(*map(F.lit, marks)), F.lit(ACCURACY)).alias("__m"))
    met = rows.select(*by, x.alias("__x")).join(F.broadcast(near) if few else near, keys)
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.col("__m")[2 * i].alias("a"), F.col("__m")[2 * i + 1].alias("b")) for i, p in enumerate(probs)])
    met = met.select(*by, "__x", "__n", F.explode(brackets).alias("__b"))
    side = F.when(F.col("__x") < F.col("__b.a"), -1).when(F.col("__x") > F.col("__b.b"), 1).otherwise(0)
    met = met.select(*by, "__x", "__n", F.col("__b.i").alias("__i"), F.col("__b.p").alias("__p"), side.alias("__s"))
    counted = met.groupBy(*by, "__i", "__p", "__n", "__s", F.when(F.col("__s") == 0, F.col("__x")).alias("__v")).agg(F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    order = Window.partitionBy(*by, "__i").orderBy("__s", "__v")
    # Next to a bracket lie the largest value below it and the smallest above it.
    own = F.when(F.col("__s") < 0, F.col("__hi")).otherwise(F.col("__lo"))
    at = F.col("__p") * (F.col("__n") - 1)
    ranked = counted.select(*by, "__i", own.alias("__v"), F.sum("__c").over(order).alias("__upto"), at.alias("__at"))
    ends = ranked.groupBy(*by, "__i", "__at").agg(F.min(F.when(F.col("__upto") > F.floor("__at"), F.col("__v"))).alias("__lo"), F.min(F.when(F.col("__upto") > F.ceil("__at"), F.col("__v"))).alias("__hi"))
    between = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise((F.ceil("__at") - F.col("__at")) * F.col("__lo") + (F.col("__at") - F.floor("__at")) * F.col("__hi"))
    found = F.array_sort(F.collect_list(F.struct("__i", F.when(F.floor("__at") == F.ceil("__at"), F.col("__lo")).otherwise(between).alias("__q"))))
    return ends.groupBy(*by).agg(F.transform(found, lambda t: t["__q"]).alias("q"))


def of_variables(df: DataFrame, variables: dict[str, Column], probs: list[float]) -> DataFrame:
    """(variable, q) of several number columns of ``df``, a row for each that has a value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), c.alias("x")) for v, c in variables.items()])).alias("s")).select("s.*")
    return quantiles(long, ["variable"], "x", probs, few=True)
