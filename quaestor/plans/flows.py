"""Streams and forms, run to their end over what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

from quaestor.operators import questionnaire
from quaestor.plans.registry import query, table
from quaestor.sources import sinks
from quaestor.streaming import collect


def _folder(spark) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/quaestor-flow-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, value FROM events")
def stream_pending(spark, d) -> DataFrame:
    """New rows staged by a stream, then applied."""
    base, schema = _folder(spark), table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    collect.pending(stream, f"{base}/staging", f"{base}/state").awaitTermination()
    collect.applied(spark, f"{base}/staging", f"{base}/data", schema)
    return spark.read.schema(schema).parquet(f"{base}/data").select("event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, d) -> DataFrame:
    """Counts by form, from a stream."""
    name, schema = f"counts_{uuid.uuid4().hex}", table(spark, d, "events").schema
    collect.live_counts(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"), "event_type", name, f"{_folder(spark)}/state").awaitTermination()
    return spark.table(name)


@query("SELECT event_id, event_type FROM events")
def stream_events(spark, d) -> DataFrame:
    """Appended JSON lines, read as a stream and staged."""
    base, rows = _folder(spark), table(spark, d, "events").select("event_id", "event_type")
    sinks.appended(rows, f"{base}/hook")
    collect.pending(collect.arrivals(spark, f"{base}/hook", rows.schema, "json"), f"{base}/staging", f"{base}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/staging")


@query()
def xlsform(spark, d) -> DataFrame:
    """The survey sheet of a form made of coded items."""
    items = [
        {"libelle": "Région", "pf_question": "Region__X!1*1Region_", "pf_modalites": "Region_=[Nord,Sud]", "pf_skip": ""},
        {"libelle": "District", "pf_question": "District__X!1*1District_", "pf_modalites": "District_=[Nord-Korhogo,Sud-Abidjan]", "pf_skip": ""},
        {"libelle": "Âge", "pf_question": "Age__1Y!0<N<120", "pf_modalites": "", "pf_skip": "Enceinte__B -> @Age__1Y"},
    ]
    rows = questionnaire.form(items)["survey"]
    return spark.createDataFrame([(r["type"], r["name"], r["relevant"], r["constraint"], r["choice_filter"]) for r in rows], "type string, name string, relevant string, constraint string, choice_filter string")
