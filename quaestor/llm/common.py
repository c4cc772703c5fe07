"""What the training-data operators share: the shared folder, written intermediate tables, folds and batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; bounds a Python worker's memory.
STEP_BYTES = 1 << 20
#: Bytes of a record batch on its way from the JVM to a Python worker; bounds what both hold of it.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_quaestor_folder", None) or tempfile.mkdtemp(prefix="quaestor-")
        spark.sparkContext._quaestor_folder = found
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this session; for when the results that read them have been written."""
    for root in getattr(spark.sparkContext, "_quaestor_tables", []):
        _delete(spark, root)
    spark.sparkContext._quaestor_tables = []


class Stash:
    """Tables written as Parquet to the shared folder and read again, so that their lineage is cut; ``drop`` removes some, and
    ``release`` those that results still read when an operator returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/quaestor-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        spark.sparkContext._quaestor_tables = [*getattr(spark.sparkContext, "_quaestor_tables", []), self.root]

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := self.paths.pop(id(table), None):
                _delete(self.spark, path)


_made: dict[str, object] = {}


def forget() -> None:
    """Frees what this worker process has made of a broadcast value, for an operator's step that needs none, and gives memory that
    earlier steps have freed back to the system."""
    _made.clear()
    give_back()


def give_back() -> None:
    """Gives memory that earlier steps have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], model: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` (for ``mapInArrow``), after which its worker gives freed memory back, and before which one that needs no model of a
    ``Held`` value forgets it. Spark deals partitions to all of an executor's idle workers in turn: without this, each of them keeps
    what its largest step took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model:
            forget()
        yield from step(batches)
        give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """From now on the session's record batches for Python workers have about BATCH_BYTES at most (a larger row has one of its own)."""
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Held:
    """A broadcast value with a key of its own, by which worker processes remember what they make of it."""

    def __init__(self, spark: SparkSession, value: object):
        self.key, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value

    def made(self, make: Callable[[object], object]):
        """What ``make`` makes of the value, made once a process; of all operators' models a process keeps the last alone."""
        if self.key not in _made:
            _made.clear()
            _made[self.key] = make(self.value)
        return _made[self.key]


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of ``column``; one row may be longer."""
    import numpy as np

    size = np.cumsum(np.frombuffer(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).buffers()[1], dtype=np.int64, count=batch.num_rows)) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def with_rest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the columns that operators read, and the row's own columns but ``text`` in a struct, so that no name clashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
