"""Columns: cleaning, resolution, coercion and filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.exprs import col, number

# Columns that collection tools add, and patterns of names that carry no answer.
META_COLUMNS = (
    "_id", "_uuid", "_submission_time", "_validation_status", "_notes", "_status", "_submitted_by", "__version__", "_tags", "meta/rootUuid", "_index", "_parent_table_name", "_parent_index", "formhub/uuid",
    "_submission__id", "_submission__uuid", "_submission__submission_time", "_submission__validation_status", "_submission__notes", "_submission__status", "_submission__submitted_by", "_submission___version__", "_submission__tags", "_submission_meta/rootUuid",
)
DROPPED = re.compile(r"^si autre|altitude|precision|précision|^(?=.*g[ée]olocalisation)(?!.*(?:latitude|longitude))", re.IGNORECASE)


def stripped(df: DataFrame) -> DataFrame:
    """Header names without surrounding blanks; rows and then columns without any value dropped."""
    df = df.toDF(*[c.strip() for c in df.columns]).na.drop("all")
    counts = df.select([F.count(col(c)).alias(str(k)) for k, c in enumerate(df.columns)]).first()
    return df.select([col(c) for k, c in enumerate(df.columns) if counts[k]])


def cleaned(df: DataFrame) -> DataFrame:
    """Without columns that hold technical data, free additions, altitude, precision or a raw place."""
    return df.select([col(c) for c in df.columns if c not in META_COLUMNS and not DROPPED.search(c)])


def flattened(df: DataFrame) -> DataFrame:
    """Arrays as text joined by ``, `` (null where empty), structs and maps as JSON."""

    def flat(f: T.StructField):
        if isinstance(f.dataType, T.ArrayType):
            return F.when(F.size(col(f.name)) > 0, F.array_join(col(f.name).cast("array<string>"), ", ")).alias(f.name)
        return F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StructType | T.MapType) else col(f.name)

    return df.select([flat(f) for f in df.schema.fields])


def resolve(df: DataFrame, name: str | None) -> str | None:
    """The column of that name, else the first that ends in ``/name``; null if none."""
    if not name:
        return None
    return name if name in df.columns else next((c for c in df.columns if c.endswith(f"/{name}")), None)


def filtered(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows whose value, as text, is in the list; unknown variables and empty lists are ignored. Text columns are not cast, so
    that the filter reaches the scan."""
    kinds = dict(df.dtypes)
    terms = [(col(v) if kinds[v] == "string" else col(v).cast("string")).isin(*map(str, values)) for v, values in wanted.items() if v in kinds and values]
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def coerced(df: DataFrame, name: str) -> DataFrame:
    """``name`` as a double; rows where it is none dropped."""
    return df.withColumn(name, number(col(name))).where(col(name).isNotNull())


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
