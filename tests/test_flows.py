"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from quaestor.plans import flows
from quaestor.sources import readers, sinks
from quaestor.streaming import collect


def test_pages_stop_after_the_limit():
    answers = {"a": {"results": [{"x": k} for k in range(3)], "next": "b"}, "b": {"results": [{"x": 9}] * 3, "next": "c"}, "c": {"results": [{"x": 1}]}}
    assert [len(p) for p in readers.pages(answers.get, "a", limit=5)] == [3, 3]
    assert sum(len(p) for p in readers.pages(answers.get, "a")) == 7


def test_paged_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"results": [{"id": f"{k}-{i}", "tags": [1, 2], "extra": 0} for i in range(4)]}))
    spark.dataSource.register(readers.PagedJson)
    df = spark.read.format("paged_json").schema("id string, tags string, none string").option("pages", "\n".join(str(p) for p in sorted(tmp_path.iterdir()))).load()
    assert df.count() == 12 and df.rdd.getNumPartitions() == 3 and df.where("none is null and tags = '[1, 2]'").count() == 12


def test_history_and_dictionary(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"date": "2026-01-02", "taux": {"F5": 55.0}}\nbroken\n\n{"date": "2026-01-01", "taux": {"F5": 50.0, "F7": 88.7}}\n')
    assert [(str(r["date"]), r["form"]) for r in readers.history(spark, str(tmp_path / "h.json")).collect()] == [("2026-01-01", "F5"), ("2026-01-01", "F7"), ("2026-01-02", "F5")]
    (tmp_path / "d.csv").write_text("nom,role\na,\nb,exclu\n")
    assert [r["role"] for r in readers.dictionary(spark, str(tmp_path / "d.csv")).collect()] == ["", "exclu"]


def test_survey_reader(spark, tmp_path):
    spark.createDataFrame([("x", [1, 2], None, 1)], "` a ` string, b array<int>, c string, _uuid int").write.parquet(str(tmp_path / "s"))
    df = readers.survey(spark, str(tmp_path / "s"))
    assert df.columns == ["a", "b"] and df.first()["b"] == "1, 2"


def test_new_rows_wait_until_applied(spark, tmp_path):
    rows = spark.range(5).select("id")
    where = {k: str(tmp_path / k) for k in ("in", "staging", "base", "state")}
    rows.write.parquet(where["in"])
    collect.pending(collect.arrivals(spark, where["in"], rows.schema), where["staging"], where["state"]).awaitTermination()
    assert collect.has_pending(spark, where["staging"], where["base"], "id", rows.schema)
    assert collect.applied(spark, where["staging"], where["base"], rows.schema) == 5 and not collect.has_pending(spark, where["staging"], where["base"], "id", rows.schema)
    rows.withColumn("id", F.col("id") + 100).write.mode("append").parquet(where["in"])
    collect.pending(collect.arrivals(spark, where["in"], rows.schema), where["staging"], where["state"]).awaitTermination()
    assert collect.has_pending(spark, where["staging"], where["base"], "id", rows.schema) and spark.read.parquet(where["staging"]).count() == 10


def test_refresh_keeps_what_is_there(spark, tmp_path):
    sinks.tables({"a": spark.range(3)}, str(tmp_path))
    assert collect.refreshed(spark, {"a": RuntimeError("down")}, str(tmp_path)) == [] and spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert collect.refreshed(spark, {"a": spark.range(4), "b": RuntimeError("down")}, str(tmp_path)) == ["a"] and spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_interval_and_ring(spark):
    assert [collect.interval(s) for s in (1, 300, 10**6)] == [60, 300, 3600]
    rows = spark.createDataFrame([("f", k, k) for k in range(50)], "form string, at int, n int")
    assert collect.ring(rows, "form", "at", 30).agg(F.min("at"), F.count("*")).first() == (20, 30)


def test_stream_queries(spark, data):
    assert flows.stream_pending(spark, data).count() == spark.read.parquet(f"{data}/events.parquet").count()
    assert flows.stream_events(spark, data).count() == spark.read.parquet(f"{data}/events.parquet").count()
