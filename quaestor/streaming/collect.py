"""Collection as streams: new submissions wait until applied; counts by form follow them; appended events are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Bounds of a polling interval in seconds.
LEAST, MOST = 60, 3600


def interval(seconds: int) -> int:
    return min(MOST, max(LEAST, seconds))


def arrivals(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def _started(writer, checkpoint: str, seconds: int | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{interval(seconds)} seconds")).start()


def pending(stream: DataFrame, staging: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """New rows go to a staging folder, exactly once; without an interval all that is there is taken and the query ends."""
    return _started(stream.writeStream.format("parquet").option("path", staging).outputMode("append"), checkpoint, seconds)


def has_pending(spark: SparkSession, staging: str, base: str, key: str, schema: StructType) -> bool:
    """Whether the staged rows differ from the applied ones in number or in their largest key."""
    both = []
    for path in (staging, base):
        try:
            both.append(tuple(spark.read.schema(schema).parquet(path).agg(F.count("*"), F.max(key)).first()))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            both.append((0, None))
    return both[0] != both[1]


def applied(spark: SparkSession, staging: str, base: str, schema: StructType) -> int:
    """The staged rows become the dataset; nothing is replaced where nothing is staged. Returns their number."""
    rows = spark.read.schema(schema).parquet(staging)
    n = rows.count()
    if n:
        rows.write.mode("overwrite").parquet(base)
    return n


def live_counts(stream: DataFrame, form: str, name: str, checkpoint: str, time: str | None = None, late: str = "1 day", seconds: int | None = None) -> StreamingQuery:
    """Submissions of each form, and by hour where a time is given: rows later than ``late`` are left out, so that state is bounded."""
    if time is None:
        counted = stream.groupBy(form).agg(F.count("*").alias("n"))
        return _started(counted.writeStream.format("memory").queryName(name).outputMode("complete"), checkpoint, seconds)
    counted = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), form).agg(F.count("*").alias("n"))
    return _started(counted.writeStream.format("memory").queryName(name).outputMode("append"), checkpoint, seconds)


def ring(counts: DataFrame, form: str, order: str, n: int = 30) -> DataFrame:
    """The last ``n`` counts of each form."""
    from pyspark.sql import Window

    w = Window.partitionBy(form).orderBy(F.desc(order))
    return counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def refreshed(spark: SparkSession, results: dict[str, DataFrame | Exception], folder: str) -> list[str]:
    """Writes the result tables that could be made; if none could, what is there stays. Returns the names written."""
    good = {k: v for k, v in results.items() if not isinstance(v, Exception)}
    for name, df in good.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return sorted(good)
