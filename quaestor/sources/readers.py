"""Sources: tables on storage, paged REST answers, appended JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quaestor.operators.cleaning import cleaned, flattened, stripped


def survey(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A survey's rows (parquet, csv, json or orc), headers stripped, technical columns dropped, nested cells flattened."""
    return flattened(cleaned(stripped(spark.read.format(kind).options(**options).load(path))))


def surveys(spark: SparkSession, paths: dict[str, str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {name: survey(spark, path, kind) for name, path in paths.items()}


def history(spark: SparkSession, path: str) -> DataFrame:
    """(date, form, taux) of daily JSON lines {date, taux: {form: rate}}, by date; lines that can't be read are left out."""
    rows = spark.read.schema("date date, taux map<string, double>").option("mode", "DROPMALFORMED").json(path)
    return rows.where("date is not null").select("date", F.explode("taux").alias("form", "taux")).orderBy("date", "form")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A variable dictionary in CSV; empty cells stay empty texts."""
    return spark.read.option("header", True).option("nullValue", "\u0000").csv(path).na.fill("")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Fetch = Callable[[str], dict]


def pages(fetch: Fetch, url: str, limit: int = 30_000) -> Iterator[list[dict]]:
    """Pages of a REST list: ``results`` and ``next``; stops after the page that reaches ``limit`` rows, which may pass it."""
    rows, at = 0, url
    while at:
        page = fetch(at)
        found = page.get("results", [])
        if found:
            yield found
        rows += len(found)
        at = page.get("next") if rows < limit else None


class _Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.options["pages"].split("\n") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for row in json.load(f).get("results", []):
                yield tuple(v if isinstance(v := row.get(n), str) or v is None else json.dumps(v) for n in self.names)


class PagedJson(DataSource):
    """Saved pages of a REST list, one partition each: option ``pages`` holds their paths, a line each; the schema's columns are texts."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)
