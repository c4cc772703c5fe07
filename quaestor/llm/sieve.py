"""A Bloom filter of ids, made on the executors and broadcast at a bounded size, that spares rows a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import Held, frugal
from quaestor.llm.kernel import STEP, U, mix

#: Bits for an id, and the logarithm of the most bits (32 MB): of more ids the filter lets more others through, and loses none.
EACH, LEAST, MOST, HASHES = 16, 10, 28, 4
#: Bytes of a row in which a partition's bits travel.
CHUNK = 1 << 16


def _places(ids: np.ndarray, log: int) -> np.ndarray:
    first = mix(ids.view(np.uint64) + STEP)
    step = mix(first ^ STEP) | U(1)
    return np.concatenate([(first + U(k) * step) >> U(64 - log) for k in range(HASHES)])


def _marked(log: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros((1 << log) >> 3, dtype=np.uint8), False
        for batch in batches:
            at = _places(np.asarray(batch.column("id")), log)
            np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))
            some |= batch.num_rows > 0
        for k, at in enumerate(range(0, len(bits), CHUNK) if some else ()):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits[at : at + CHUNK].tobytes()])], ["chunk", "bits"])

    return run


def _united(table: pa.Table) -> pa.Table:
    bits = np.frombuffer(table["bits"][0].as_py(), np.uint8).copy()
    for other in table["bits"][1:]:
        bits |= np.frombuffer(other.as_buffer(), np.uint8)
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()])})


class Sieve:
    """A test of long values: true for every id of ``ids`` (id: long, not null) and for some others; false for null and, where ``ids``
    is empty, for all. Called on a column it gives one; a step for ``mapInArrow`` asks ``has`` itself, as a column's test below it
    would take a worker of its own beside that of the step."""

    def __init__(self, ids: DataFrame):
        count = ids.agg(F.approx_count_distinct("id")).first()[0]
        self.log = min(max(LEAST, int(count * EACH).bit_length()), MOST)
        bits = np.zeros((1 << self.log) >> 3, dtype=np.uint8)
        for chunk, part in ids.select("id").mapInArrow(frugal(_marked(self.log)), "chunk int, bits binary").groupBy("chunk").applyInArrow(_united, "chunk int, bits binary").collect():  # 32 MB at most
            bits[chunk * CHUNK : chunk * CHUNK + len(part)] = np.frombuffer(part, np.uint8)
        self.held = Held(ids.sparkSession, bits)

    def has(self, x: pa.Array) -> pa.Array:
        at = _places(np.asarray(pc.fill_null(x, 0)).astype(np.int64), self.log)
        hit = (self.held.value[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1)
        return pc.and_(pa.array(hit.reshape(HASHES, -1).all(axis=0)), pc.is_valid(x))

    def __call__(self, column: Column) -> Column:
        @F.arrow_udf("boolean")
        def test(x: pa.Array) -> pa.Array:
            return self.has(x)

        return test(column)


sieve = Sieve
