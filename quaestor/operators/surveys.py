"""Several surveys: coded names align their columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.exprs import SUFFIXES, col, number
from quaestor.operators import inference, pivot

SURVEY = "__survey__"
CODED = re.compile(rf"^(.+?)__({SUFFIXES})(.*)$")
#: Statistical keys whose variables are compared.
COMPARED = ("B", "C", "X_one", "X_multi", "period", "I")


def radical(name: str) -> str:
    return m[1] if (m := CODED.match(name)) else name


def code_type(name: str) -> str | None:
    return m[2] if (m := CODED.match(name)) else None


def stat_key(suffix: str | None, multiple: bool = False) -> str | None:
    """period for numbers, X_one or X_multi for choices, the suffix itself where it has statistics of its own."""
    if not suffix:
        return None
    if suffix[0] in "12":
        return "period"
    if suffix == "X":
        return "X_multi" if multiple else "X_one"
    return suffix if suffix in ("B", "A", "Z", "C", "I", "E") else None


def merged(surveys: dict[str, DataFrame], mode: str = "union") -> DataFrame:
    """All rows with their survey's name in ``__survey__``. Mode ``phakts`` names columns by their radicals, the first of equal ones
    staying; ``exact`` and ``union`` keep names and do the same. Columns of unlike types become text."""
    frames = {}
    for name, df in surveys.items():
        if mode == "phakts":
            first: dict[str, str] = {}
            for c in df.columns:
                first.setdefault(radical(c), c)
            df = df.select([col(c).alias(r) for r, c in first.items()])
        frames[name] = df
    kinds: dict[str, set[str]] = defaultdict(set)
    for df in frames.values():
        for c, t in df.dtypes:
            kinds[c].add(t)
    out = None
    for name, df in frames.items():
        df = df.select([col(c).cast("string").alias(c) if len(kinds[c]) > 1 else col(c) for c in df.columns]).withColumn(SURVEY, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no survey")
    return out


def names(spark: SparkSession, surveys: dict[str, DataFrame]) -> DataFrame:
    """(survey, variable): the columns of each survey."""
    return spark.createDataFrame([(s, c) for s, df in surveys.items() for c in df.columns], "survey string, variable string")


def coverage(spark: SparkSession, surveys: dict[str, DataFrame]) -> DataFrame:
    """(variable, one 0/1 column a survey, total), the widest first."""
    out = names(spark, surveys).groupBy("variable").pivot("survey", list(surveys)).agg(F.count("variable").cast("int")).na.fill(0)
    return out.withColumn("total", sum((col(s) for s in surveys), F.lit(0))).orderBy(F.desc("total"), "variable")


def common_variables(spark: SparkSession, surveys: dict[str, DataFrame]) -> DataFrame:
    return names(spark, surveys).groupBy("variable").agg(F.count_distinct("survey").alias("n")).where(F.col("n") == len(surveys)).select("variable").orderBy("variable")


def all_variables(spark: SparkSession, surveys: dict[str, DataFrame]) -> DataFrame:
    return names(spark, surveys).select("variable").where(F.col("variable") != SURVEY).distinct().orderBy("variable")


def common_indicators(spark: SparkSession, surveys: dict[str, DataFrame], least: int = 2) -> DataFrame:
    """(radical, suffix, key, n): coded columns of ``least`` surveys or more, with their commonest suffix, of equals the smallest."""
    seen: dict[str, dict[str, str]] = defaultdict(dict)
    for s, df in surveys.items():
        for c in df.columns:
            if (t := code_type(c)) is not None:
                seen[radical(c)].setdefault(s, t)
    lines = []
    for r, by in seen.items():
        suffix = min(Counter(by.values()).items(), key=lambda kv: (-kv[1], kv[0]))[0]
        if len(by) >= least and stat_key(suffix) in COMPARED:
            lines.append((r, suffix, stat_key(suffix), len(by)))
    return spark.createDataFrame(sorted(lines, key=lambda x: (-x[3], x[0])), "radical string, suffix string, key string, n int")


def compare_categories(df: DataFrame, name: str) -> DataFrame:
    """(value, survey, n, pct): counts and shares within each survey."""
    out = pivot.cells(df, [name], [SURVEY])
    pct = pivot.percent(out, "col", [name], [SURVEY]).withColumnRenamed("value", "pct")
    return out.join(pct, [name, SURVEY]).select(col(name).cast("string").alias("value"), F.col(SURVEY).alias("survey"), F.col("value").cast("long").alias("n"), "pct")


def compare_numbers(df: DataFrame, name: str) -> DataFrame:
    return inference.group_figures(df, SURVEY, name).withColumnRenamed("group", "survey")


def continuous(df: DataFrame, name: str) -> bool:
    """More than 80 percent numbers among the values, and more than 10 distinct ones."""
    share, distinct = df.agg(F.count(number(col(name))) / F.nullif(F.count(col(name)), F.lit(0)), F.count_distinct(number(col(name)))).first()
    return (share or 0) > 0.8 and distinct > 10


def auto_analysis(surveys: dict[str, DataFrame], least: int = 2) -> list[tuple[str, str, DataFrame, DataFrame]]:
    """(radical, key, comparison, test) of each common indicator."""
    df = merged(surveys, "phakts")
    spark, out = df.sparkSession, []
    for r in common_indicators(spark, surveys, least).collect():
        name, key = r["radical"], r["key"]
        if key in ("period", "I"):
            out.append((name, key, compare_numbers(df, name), inference.compare_groups(df, SURVEY, name)))
        else:
            out.append((name, key, compare_categories(df, name), pivot.chi2(df, name, SURVEY)))
    return out


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in a wanted schema: missing columns null, values that do not fit null."""
    return df.select([(col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
