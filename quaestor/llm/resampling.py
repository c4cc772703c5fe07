"""Quality by importance resampling: the ratio of two hashed n-gram generative models, for target and for raw text, weighs each
document, and Gumbel top-k draws documents without replacement in proportion to their weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.common import Held, Stash, as_before, frugal, slices, with_rest
from quaestor.llm.kernel import U, utf8, word_hashes

#: Buckets of the hashed n-grams; lengths of the byte n-grams; labelled rows that the target model is fitted on, at most.
BUCKETS, LENGTHS, LABELLED = 1 << 16, (2, 3, 4), 20_000
#: Buckets of their own for whether a word repeats the one before, the one before that, both or none: generated spam does.
PATTERNS = 4
CHUNK = 1024
#: Bytes of text whose n-grams a worker holds at once.
STEP = 1 << 18
SIZE = BUCKETS + CHUNK
#: How many kept bad documents weigh as much as one lost good one (both as shares): a lost one can't be got back. The allowance
#: below the border for the draw's noise: Gumbel noise is below -3 once in 5e8 rows.
DEAR, ALLOWANCE = 20.0, 3.0


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all rows and the row of each: byte n-grams, and whether words repeat one of the two before."""
    data, at = utf8(texts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    x = data.astype(np.uint64) + U(1)
    buckets, rows = [], []
    for n in LENGTHS:
        if len(x) < n:
            continue
        h = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            h = h * U(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9 + 2 * n)
        inside = row[: len(h)] == row[n - 1 :]
        buckets.append((h >> U(48)).astype(np.int64)[inside])
        rows.append(row[: len(h)][inside])
    words, starts = word_hashes(texts)
    if len(words) > 2:
        own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        same = (words[2:] == words[1:-1]) * 2 + (words[2:] == words[:-2])
        inside = own[2:] == own[:-2]
        buckets.append(BUCKETS + same[inside])
        rows.append(own[2:][inside])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *buckets]), np.concatenate([none, *rows])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of buckets a row with the counts of this partition: of all rows, and of the target rows."""
    raw, target = np.zeros(SIZE, dtype=np.int64), np.zeros(SIZE, dtype=np.int64)
    for whole in batches:
        for batch in slices(whole, "text", STEP):
            b, row = grams(batch.column("text"))
            raw += np.bincount(b, minlength=SIZE)
            good = np.asarray(batch.column("quality").fill_null(0)) == 1
            if good.any():
                target += np.bincount(b[good[row]], minlength=SIZE)
    if raw.any():
        for c in range(0, SIZE, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([raw[c : c + CHUNK].tobytes()]), pa.array([target[c : c + CHUNK].tobytes()])], ["chunk", "raw", "target"])


def _summed(table: pa.Table) -> pa.Table:
    add = lambda name: sum(np.frombuffer(x, dtype=np.int64) for x in table[name].to_pylist()).tobytes()
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "raw": pa.array([add("raw")]), "target": pa.array([add("target")])})


def _weighed(held, keep: tuple[str, ...] = ("doc_id", "quality")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held.value
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                b, row = grams(batch.column("text"))
                weight = np.bincount(row, weights=ratio[b], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(np.bincount(row, minlength=batch.num_rows)), pa.array(weight)], [*keep, "n_grams", "log_weight"])

    return run


def cut(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key``, found by narrowing a histogram; about 1000 rows or one bin's keys reach the driver at a time."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= (n or 0):
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        step = (hi - lo) / 1000
        if step == 0 or lo + step == lo:
            return lo
        counts = dict(inside.groupBy(F.least(F.floor((F.col("key") - lo) / step), F.lit(999)).alias("b")).count().collect())
        for b in range(999, -1, -1):
            if above + counts.get(b, 0) >= k:
                break
            above += counts.get(b, 0)
        bins = inside.where(F.least(F.floor((F.col("key") - lo) / step), F.lit(999)) == b)
        if counts[b] <= 5_000:
            return sorted((r[0] for r in bins.select("key").collect()), reverse=True)[k - above - 1]
        lo, hi = bins.agg(F.min("key"), F.max("key")).first()


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    The raw model counts the n-grams of all rows; the target model those of rows that ``labels`` (doc_id, quality) call good
    (1), of LABELLED labelled rows chosen by hash. ``log_weight``: log of the text's probability under the target model over
    that under the raw model. ``key``: log_weight plus Gumbel noise from a hash of the id; the ``k`` rows with the largest keys
    are kept, ties with the last as well. ``k`` defaults to the number of rows whose weight is at least ``border``'s between
    good and bad labelled rows (those that the model was fitted on), less ALLOWANCE. A null or empty text has weight 0. Without good labels, and for k
    above the number of rows, all are kept. Labels that contradict each other count as not good. Rows that repeat an id each
    have a row; no rows give no rows.
    """
    keyed, least, _ = _keyed(docs, labels, k, seed)
    return keyed.withColumn("kept", F.col("key") >= F.lit(least))


def accepted(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17) -> DataFrame:
    """The rows that ``resampled`` keeps, with the columns of ``docs``: each row is weighed again, so that texts are not joined."""
    _, least, ratio = _keyed(docs, labels, k, seed)
    held = with_rest(docs)
    schema = T.StructType([held.schema["doc_id"], held.schema["text"], held.schema["rest"]]).add("n_grams", "long").add("log_weight", "double")
    out = held.mapInArrow(frugal(_weighed(Held(docs.sparkSession, ratio), ("doc_id", "text", "rest"))), schema)
    return as_before(out.where(_key(seed) >= F.lit(least)), docs)


def border(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which documents count as good: the one that costs least, of equal ones the smallest."""
    at = np.unique(good)
    if not len(at):
        return -np.inf
    lost = np.searchsorted(np.sort(good), at, side="left") / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), at, side="left") / max(len(bad), 1) if len(bad) else np.zeros(len(at))
    return float(at[np.argmin(DEAR * lost + kept)])


def _key(seed: int) -> Column:
    """The log weight plus Gumbel noise from a hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    return F.col("log_weight") - F.log(-F.log(uniform))


def _keyed(docs: DataFrame, labels: DataFrame, k: int | None, seed: int) -> tuple[DataFrame, float, np.ndarray]:
    """(doc_id, n_grams, log_weight, key) of all rows, the least key that is kept, and the models' log ratio for each bucket."""
    spark = docs.sparkSession
    stash = Stash(spark)
    clean = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    count = clean.count()
    chosen = clean.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < int(min(1.0, LABELLED / max(count, 1)) * (1 << 20))).limit(2 * LABELLED).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left")
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    for c, r, t in rows.mapInArrow(frugal(_counted), "chunk int, raw binary, target binary").groupBy("chunk").applyInArrow(_summed, "chunk int, raw binary, target binary").collect():  # SIZE / CHUNK rows
        raw[c : c + CHUNK], target[c : c + CHUNK] = np.frombuffer(r, dtype=np.int64), np.frombuffer(t, dtype=np.int64)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS + PATTERNS)) - np.log((raw + 1) / (raw.sum() + BUCKETS + PATTERNS)) if target.any() else np.zeros(SIZE)
    weighed = stash.put(rows.mapInArrow(frugal(_weighed(Held(spark, ratio))), "doc_id long, quality int, n_grams long, log_weight double"))
    keyed = weighed.withColumn("key", _key(seed))
    if k is None:
        known = np.array([tuple(r) for r in weighed.where("quality is not null").select("quality", "log_weight").collect()], dtype=float).reshape(-1, 2)  # 2 * LABELLED rows at most
        k = weighed.where(F.col("log_weight") >= border(known[known[:, 0] == 1, 1], known[known[:, 0] != 1, 1]) - ALLOWANCE).count() if target.any() else 1 << 62
    return keyed.select("doc_id", "n_grams", "log_weight", "key"), cut(keyed, k), ratio
