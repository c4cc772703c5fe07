"""Sinks: result tables to folders."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Over what is there; CSV with a header."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def tables(results: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One folder for each table."""
    for name, df in results.items():
        table(df, f"{folder}/{name}", kind)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
