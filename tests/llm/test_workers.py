"""What Python workers hold: batches, freed memory, and one worker for each task."""

import gc
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaestor.llm import common, packing

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_packing_lets_go_of_its_ids():
    plans, leaf = packing.plan([40 * 50, 40 * 50])
    ids = [np.arange(40 * k, 40 * k + 40, dtype="<u4").tobytes() for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([k % 2 for k in range(100)], pa.int32()), pa.array([40 * (k // 2) for k in range(100)]), pa.array(ids, pa.binary())], ["doc_id", "queue", "place", "ids"])
    views = lambda: sum(type(x) is memoryview for x in gc.get_objects())
    before = views()
    for with_ids in (False, True):
        got = {}
        for out in packing._cut(plans, leaf, with_ids)([batch]):
            for r in out.to_pylist():
                got[r["doc_id"], r["start"]] = r.get("ids")
        if with_ids:
            assert [b"".join(got[x] for x in sorted(got) if x[0] == k) for k in range(100)] == ids
    assert views() == before


def test_no_task_needs_two_workers(spark, data, monkeypatch):
    import corpus_pipeline

    plans, put = [], common.Stash.put

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df)

    monkeypatch.setattr(common.Stash, "put", seen)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        common.Stash(spark).put(stage(spark, docs, data))
    assert sum("MapInArrow" in p for p in plans) >= 6
    assert not [p for p in plans if "MapInArrow" in p and "ArrowEvalPython" in p]


def test_batches_are_bounded(spark, data):
    import corpus_pipeline

    rows = spark.range(4000, numPartitions=1).select(F.lpad(F.col("id").cast("string"), 10_000, "x").alias("text"))
    sizes = lambda: [r[0] for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    before = spark.conf.get(KEY)
    try:
        corpus_pipeline.language(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
        assert max(sizes()) < 1.1 * common.BATCH_BYTES and sum(sizes()) > 4e7
        spark.conf.set(KEY, "1m")
        common.small_batches(spark)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)


def test_workers_give_memory_back():
    # Blocks that malloc keeps, below one that is still held.
    code = """
import re, numpy as np
from quaestor.llm import common
mb = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def step(batches):
    held = [np.ones(10_000) for _ in range(2000)]
    common._made["pin"] = np.ones(10_000)
    del held
    yield mb()
before = mb()
used = next(iter(step([]))) - before
list(common.frugal(step)([]))
print(used, mb() - before)
"""
    used, kept = map(float, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=common.__file__.rsplit("/quaestor/", 1)[0]).stdout.split())
    assert used > 100 and kept < 40
