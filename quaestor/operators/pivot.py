"""Pivots and contingency tables. Cells are kept in long form; ``wide`` spreads them over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.exprs import col, number
from quaestor.operators.cleaning import filtered
from quaestor.operators.quantiles import quantiles

AGGREGATES = ("count", "sum", "mean", "median", "min", "max", "std", "nunique")


def _aggregate(name: str, value: str | None) -> Column:
    """Unknown names count."""
    if name not in AGGREGATES or name == "count":
        return F.count("*").cast("double")
    if value is None:
        raise ValueError(f"{name} needs a value variable")
    x = number(col(value))
    return {"sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.stddev_samp(x), "nunique": F.count_distinct(x).cast("double")}[name]


def cells(df: DataFrame, rows: list[str], cols: list[str] = (), value: str | None = None, agg: str = "count", filters: dict[str, list[str]] | None = None, fill: float | None = 0.0) -> DataFrame:
    """A row for each combination of the row variables and the column variables found: ``rows``, ``cols`` and ``value``.

    The filter comes before the projection; rows with a null key, or without a number where one is needed, are left out. Cells
    that no row falls in get ``fill``, for every aggregate (None: they are absent).
    """
    if not rows:
        raise ValueError("a pivot needs a row variable")
    needs = agg in AGGREGATES and agg != "count"
    df = filtered(df, filters or {}).na.drop(subset=[*rows, *cols])
    if needs and value is not None:
        df = df.where(number(col(value)).isNotNull())
    if agg == "median":
        if value is None:
            raise ValueError("median needs a value variable")
        out = quantiles(df.withColumn("__value", number(col(value))), [*rows, *cols], "__value", [0.5]).select(*map(col, [*rows, *cols]), F.col("q")[0].alias("value"))
    else:
        out = df.groupBy(*map(col, [*rows, *cols])).agg(_aggregate(agg, value).alias("value"))
    if not cols or fill is None:
        return out
    # The grid of keys that occur: as many cells as the pivot has.
    left, right = out.select(*map(col, rows)).distinct(), out.select(*map(col, cols)).distinct()
    return left.crossJoin(right).join(out, [*rows, *cols], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def percent(out: DataFrame, mode: str, rows: list[str], cols: list[str]) -> DataFrame:
    """The cells' shares of their row, column or the total, 1 digit; null where the total is 0."""
    share = lambda total: F.round(100.0 * F.col("value") / F.nullif(total, F.lit(0.0)), 1)
    if mode == "total":
        return out.join(F.broadcast(out.agg(F.sum("value").alias("__all")))).withColumn("value", share(F.col("__all"))).drop("__all")
    return out.withColumn("value", share(F.sum("value").over(Window.partitionBy(*map(col, {"row": rows, "col": cols}[mode])))))


def margins(out: DataFrame, row: str, column: str, label: str = "Total") -> DataFrame:
    """The cells and, as ``label``, the sums of their rows, columns and all, whatever the aggregate."""
    sums = out.cube(col(row).alias(row), col(column).alias(column)).agg(F.sum("value").alias("value"), F.grouping_id().alias("g"))
    return sums.select(*[F.when(F.col("g").bitwiseAND(bit) != 0, label).otherwise(col(c).cast("string")).alias(c) for c, bit in ((row, 2), (column, 1))], "value")


def wide(out: DataFrame, rows: list[str], cols: list[str], values: list | None = None) -> DataFrame:
    """One column for each column key; several column variables are joined by `` | ``."""
    keyed = out.withColumn("__key", F.concat_ws(" | ", *[col(c).cast("string") for c in cols]))
    return keyed.groupBy(*map(col, rows)).pivot("__key", values).agg(F.first("value")).na.fill(0.0)


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, col, observed, expected, residual, contribution) of each cell; residual: (O - E) / root of E, 2 digits."""
    out = cells(df, [row], [column]).select(col(row).alias("row"), col(column).alias("col"), F.col("value").alias("observed"))
    by_row, by_col = Window.partitionBy("row"), Window.partitionBy("col")
    expected = F.sum("observed").over(by_row) * F.sum("observed").over(by_col) / F.col("all")
    out = out.join(F.broadcast(out.agg(F.sum("observed").alias("all")))).withColumn("expected", expected)
    gap = F.col("observed") - F.col("expected")
    return out.select("row", "col", "observed", F.round("expected", 4).alias("expected"), F.round(gap / F.sqrt("expected"), 2).alias("residual"), (gap * gap / F.col("expected")).alias("contribution"))


def chi2(df: DataFrame, row: str, column: str) -> DataFrame:
    """(statistic, p, dof, cramers_v, significance, strength): one row; corrected where the table is 2 by 2.

    Cells that no row falls in add their expected count: only those that occur are counted. The driver gets sums, and the cells
    themselves where they are four."""
    from quaestor.functions.stats import chi2_tail, chi2_test, significance, strength

    found = cells(df, [row], [column], fill=None).select(col(row).cast("string").alias("r"), col(column).cast("string").alias("c"), F.col("value").alias("o"))
    rows, cols, n = found.agg(F.count_distinct("r"), F.count_distinct("c"), F.sum("o")).first()
    dof = max(rows - 1, 0) * max(cols - 1, 0)
    if dof == 1:
        four = {(t["r"], t["c"]): t["o"] for t in found.collect()}
        x, p, dof, v = chi2_test([[four.get((a, b), 0.0) for b in sorted({c for _, c in four})] for a in sorted({r for r, _ in four})])
    elif dof:
        sums = lambda c: found.groupBy(c).agg(F.sum("o").alias(f"n_{c}"))
        e = F.col("n_r") * F.col("n_c") / F.lit(n)
        x = found.join(sums("r"), "r").join(sums("c"), "c").agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e - e)).first()[0] + n
        p, v = chi2_tail(x, dof), (x / (n * (min(rows, cols) - 1))) ** 0.5
    line = (None, None, 0, None, None, None) if not dof else (round(x, 4), p, dof, round(v, 3), significance(p), strength(v))
    return df.sparkSession.createDataFrame([line], "statistic double, p double, dof int, cramers_v double, significance string, strength string")


def melted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, col, n): the counts of a report's cross table, both variables read as text; cells that no row falls in have 0."""
    text = df.select(col(row).cast("string").alias("row"), col(column).cast("string").alias("col"))
    return cells(text, ["row"], ["col"]).select("row", "col", F.col("value").cast("long").alias("n"))
