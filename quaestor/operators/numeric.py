"""Summaries of numeric variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.exprs import adjusted_kurtosis, adjusted_skewness, col, normality, number
from quaestor.operators.quantiles import of_variables


def _figures(name: str) -> Column:
    x = number(col(name))
    return F.struct(
        F.lit(name).alias("variable"), F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("missing"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        adjusted_skewness(x).alias("skew"), adjusted_kurtosis(x).alias("kurt"),
    )


def summaries(df: DataFrame, names: list[str]) -> DataFrame:
    """A row of figures for each variable, from one pass and two for the quartiles; the sample deviation, exact quartiles and adjusted shape, rounded to 4
    digits, the 95 percent interval of the mean by 1.96 standard errors, and the shape's label. No value: nulls."""
    rows = df.agg(F.array(*map(_figures, names)).alias("x")).select(F.inline("x"))
    quartiles = of_variables(df, {n: number(col(n)) for n in names}, [0.25, 0.5, 0.75])
    rows = rows.join(F.broadcast(quartiles), "variable", "left").select("*", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    error = 1.96 * F.col("std") / F.sqrt(F.nullif(F.col("n"), F.lit(0)).cast("double"))
    r = lambda c: F.round(c, 4)
    return rows.select(
        "variable", "n", "missing", *[r(F.col(c)).alias(c) for c in ("min", "max")], r(F.col("max") - F.col("min")).alias("range"), *[r(F.col(c)).alias(c) for c in ("mean", "median", "std")],
        r(100 * F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"), r(F.col("q1")).alias("q1"), r(F.col("q3")).alias("q3"), r(F.col("q3") - F.col("q1")).alias("iqr"), *[r(F.col(c)).alias(c) for c in ("skew", "kurt")],
        r(F.col("mean") - error).alias("ci_low"), r(F.col("mean") + error).alias("ci_high"), normality(F.col("skew"), F.col("kurt")).alias("shape"),
    )


def outliers(df: DataFrame, name: str, least: int = 4) -> DataFrame:
    """(n, count, pct, lower, upper, extreme_low, extreme_high): values beyond 1.5 interquartile ranges; none under ``least`` values."""
    x = number(col(name))
    fences = df.agg(F.count(x).alias("n")).join(F.broadcast(of_variables(df, {name: x}, [0.25, 0.75])), F.lit(True), "left").select("n", (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("lower"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("upper"))
    below, above = F.col("x") < F.col("lower"), F.col("x") > F.col("upper")
    out = df.select(x.alias("x")).join(F.broadcast(fences)).agg(F.max("n").alias("n"), F.sum((below | above).cast("long")).alias("c"), F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.min(F.when(below, F.col("x"))).alias("extreme_low"), F.max(F.when(above, F.col("x"))).alias("extreme_high"))
    enough = F.col("n") >= least
    return out.select("n", F.when(enough, F.coalesce("c", F.lit(0))).otherwise(0).cast("long").alias("count"), F.when(enough, F.round(100.0 * F.coalesce("c", F.lit(0)) / F.col("n"), 1)).otherwise(0.0).alias("pct"), *[F.when(enough, F.round(c, 3)).alias(c) for c in ("lower", "upper", "extreme_low", "extreme_high")])


def bins_for(n: int, rule: str = "sqrt", distinct: int | None = None) -> int:
    """Bins of a histogram: min(30, max(5, root of n)), or min(30 or 25, distinct values)."""
    return max(1, min(30, max(5, int(n**0.5))) if rule == "sqrt" else min(30 if rule == "distinct" else 25, distinct or 1))


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n, density): equal bins over the range, the last one closed; empty bins included."""
    x = number(col(name))
    lo, hi, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, low double, high double, n long, density double")
    bins = bins or bins_for(n)
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    step = (hi - lo) / bins
    which = F.least(F.floor((x - lo) / step), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select(
        "bin", F.round(lo + F.col("bin") * step, 4).alias("low"), F.round(lo + (F.col("bin") + 1) * step, 4).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / (n * step), 8).alias("density")
    )


def density(df: DataFrame, name: str, points: int = 250, bins: int = 4096) -> DataFrame:
    """(x, y): a Gaussian kernel estimate on a grid, Scott's bandwidth; from a fine histogram, so that its work is bounded."""
    x = number(col(name))
    lo, hi, n, std = df.agg(F.min(x), F.max(x), F.count(x), F.stddev_samp(x)).first()
    spark = df.sparkSession
    if not n or n < 3 or not std:
        return spark.createDataFrame([], "x double, y double")
    h, step = std * n ** (-0.2), (hi - lo) / bins
    cells = df.where(x.isNotNull()).groupBy(F.least(F.floor((x - lo) / step), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("w"), F.avg(x).alias("c"))
    held = cells.agg(F.collect_list(F.struct("c", "w")).alias("cells"))  # at most ``bins`` of them
    grid = spark.range(points).select((F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("x")).join(F.broadcast(held))
    total = F.aggregate("cells", F.lit(0.0), lambda acc, k: acc + k["w"] * F.exp(-0.5 * F.pow((F.col("x") - k["c"]) / h, 2)))
    return grid.select(F.round("x", 6).alias("x"), F.round(total / (n * h * 2.5066282746310002), 10).alias("y"))


def normal_curve(df: DataFrame, name: str, points: int = 200) -> DataFrame:
    """(x, y): the normal density of the variable's mean and deviation over its range."""
    x = number(col(name))
    figures = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    at = F.col("lo") + F.col("id") * ((F.col("hi") - F.col("lo")) / (points - 1))
    return df.sparkSession.range(points).join(F.broadcast(figures)).where("s > 0").select(F.col("id").cast("int").alias("i"), F.round(at, 4).alias("x"), F.round(F.exp(-0.5 * F.pow((at - F.col("m")) / F.col("s"), 2)) / (F.col("s") * 2.5066282746310002), 10).alias("y"))


def correlations(df: DataFrame, names: list[str], digits: int = 2) -> DataFrame:
    """(a, b, r): Pearson's coefficient of each pair, over rows where both have values; the lower triangle without its diagonal."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(number(col(a)), number(col(b))), digits).alias("r")) for a, b in pairs]
    return df.agg(F.array(*items).alias("x")).select(F.inline("x")) if items else df.sparkSession.createDataFrame([], "a string, b string, r double")


def mean_interval(df: DataFrame, name: str, level: float = 0.95) -> DataFrame:
    """(n, mean, low, high): Student's interval of the mean."""
    from quaestor.functions.stats import t_quantile

    x = number(col(name))
    n, mean, std = df.agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
    half = t_quantile(1 - (1 - level) / 2, n - 1) * std / n**0.5 if n > 1 else None
    return df.sparkSession.createDataFrame([(n, mean, mean - half if half is not None else None, mean + half if half is not None else None)], "n long, mean double, low double, high double")
