"""Near-duplicate vectors by sorted projection passes: each pass orders the vectors by concatenated random hashes, compares
bounded windows of neighbours, and the verified pairs of all passes are united to components. Within a component all pairs are
then compared, in blocks, so that groups larger than a window have all their links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import Stash
from quaestor.llm.components import components

#: Passes, bits of a key, neighbours that each vector is compared with in a pass, and rows of a block (a task's unit).
PASSES, BITS, WINDOW, BLOCK = 24, 60, 512, 1024
#: Rows of a part of a large component (eight times that where it would have more than PARTS), and of a bucket of small ones.
PART, PARTS, BUCKET = 1024, 32, 512
#: Components of more than one part whose numbers of parts may be broadcast, 16 bytes each.
LARGE = 200_000


def usable(vectors: DataFrame) -> DataFrame:
    """(id, e) of the rows whose vector is not null, empty or zero and has only finite components; e: array<double>, without -0."""
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = F.col("vec_id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").alias("id"), "e")


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of an Arrow column, which all have one length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector."""
    sizes = np.asarray(pc.list_value_length(column))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, matrix(column.take(pa.array(rows)))


def keys(x: np.ndarray, passes: int, bits: int, seed: int = 3) -> np.ndarray:
    """A key for each row and pass: the signs of random projections, one after another, as a number."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], passes * bits))
    signs = (x @ planes > 0).reshape(len(x), passes, bits)
    return signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(x: np.ndarray) -> pa.Array:
    """Each vector's direction as 16-bit steps, after the size of a step (8 bytes): a quarter of it in double precision."""
    x = unit(x)
    step = np.abs(x).max(axis=1) / 32767
    return pa.array([a.tobytes() + b.tobytes() for a, b in zip(step, np.rint(x / step[:, None]).astype(np.int16), strict=True)], pa.binary())


def unpacked(column: list[bytes]) -> tuple[np.ndarray, float]:
    """The directions, of one length, and a bound of the error of two vectors' product."""
    held = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    step = held[:, :8].copy().view(np.float64)
    x = held[:, 8:].copy().view(np.int16) * step
    error = float(step.max()) * x.shape[1] ** 0.5 / 2
    return x, 2 * error + error * error + 1e-9


def _keyed(passes: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                for rows, x in _by_length(batch.column("e")):
                    found = keys(x, passes, bits)
                    ids, held = batch.column("id").take(pa.array(rows)), packed(x)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int32()), pa.array([x.shape[1]] * len(rows), pa.int32()), pa.array(found[:, p]), ids, held], ["pass", "size", "key", "id", "q"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), pa.array(np.arange(at, at + batch.num_rows)), *(batch.column(c) for c in ("pass", "id", "q"))], ["part", "place", "pass", "id", "q"])
        at += batch.num_rows


def cosine_at_least(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Row by row, in double precision."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot >= threshold * np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))


def _compared(window: int, block: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rank")
        number = table["block"][0].as_py() if table.num_rows else 0
        ids, rank, pas = (np.asarray(table[c]) for c in ("id", "rank", "pass"))
        held = table["q"].combine_chunks()
        size = np.asarray(pc.binary_length(held))
        u, v, sure = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            x, error = unpacked(held.take(pa.array(rows)).to_pylist())
            for at in range(0, len(rows), 256):
                near = x[at : at + 256] @ x[at:].T
                i, j = np.nonzero(near >= threshold - error)
                a, b = rows[i + at], rows[j + at]
                fine = (rank[b] > rank[a]) & (rank[b] - rank[a] <= window) & (rank[a] < (number + 1) * block) & (pas[a] == pas[b]) & (ids[a] != ids[b])
                a, b, c = ids[a[fine]], ids[b[fine]], near[i[fine], j[fine]]
                u.append(np.minimum(a, b))
                v.append(np.maximum(a, b))
                sure.append(c >= threshold + error)
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v), "sure": np.concatenate(sure)})

    return run


def _near_enough(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [len(a) == len(b) and bool(cosine_at_least(*(x[None] / np.abs(x).max() for x in (np.asarray(a.values), np.asarray(b.values))), threshold)[0]) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    return run


def _verified(open_: DataFrame, classes: DataFrame, stash: Stash, threshold: float, count: int) -> DataFrame:
    """Those of ``open_`` (u, v) whose vectors have a cosine of ``threshold`` or more."""
    ends = open_.select(F.col("u").alias("id")).unionByName(open_.select(F.col("v").alias("id"))).distinct()
    held = stash.put(classes.join(F.broadcast(ends) if count <= LARGE else ends.hint("merge"), "id", "left_semi"))
    both = open_.join(held.select(F.col("id").alias("u"), F.col("e").alias("a")).hint("merge"), "u").join(held.select(F.col("id").alias("v"), F.col("e").alias("b")).hint("merge"), "v")
    return both.mapInArrow(_near_enough(threshold), "u long, v long").distinct()


def pairs(classes: DataFrame, stash: Stash, threshold: float, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(u, v), u < v: the pairs of ``classes`` (id, e) that are near in some pass and have a cosine of ``threshold`` or more.

    The passes carry directions in 16-bit steps; pairs within their error of the threshold are compared by the vectors themselves.
    """
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.mapInArrow(_keyed(passes, bits), "pass int, size int, key long, id long, q binary")
    # Equal keys lie in another order in each pass.
    tie = F.xxhash64("pass", "id")
    ordered = keyed.repartitionByRange(parts, "pass", "size", "key", tie).sortWithinPartitions("pass", "size", "key", tie, "id")
    ordered = stash.put(ordered.mapInArrow(_numbered, "part int, place long, pass int, id long, q binary"))
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in ordered.groupBy("part").count().collect()):  # a row for each partition
        before[part], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    ranked = ordered.select("pass", "id", "q", (start + F.col("place")).cast("long").alias("rank"))
    own = F.floor(F.col("rank") / block).cast("long")
    # A block's last vectors see the first ones of the next: these also go to the block before.
    back = int(np.ceil(window / block))
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: F.when((k == 0) | ((own >= k) & (F.col("rank") - own * block < window - (k - 1) * block)), own - k)), lambda k: k.isNotNull())
    dealt = ranked.select(F.explode(blocks).alias("block"), "rank", "pass", "id", "q")
    found = stash.put(dealt.groupBy("block").applyInArrow(_compared(window, block, threshold), "u long, v long, sure boolean").groupBy("u", "v").agg(F.max("sure").alias("sure")))
    stash.drop(ordered)
    clear, open_ = found.where("sure").select("u", "v"), found.where("not sure").select("u", "v")
    count = open_.count()
    return clear.unionByName(_verified(open_, classes, stash, threshold, count)) if count else clear


def _linked(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, marks, n, part, component = (np.asarray(table[c]) for c in ("id", "mark", "n", "part", "component"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        others, weight = np.zeros(len(ids)), n.astype(np.float64)
        for rows, x in _by_length(table["e"].combine_chunks()):
            # Each one's rows lie together; of two parts, each row of the first meets each of the second.
            order = np.argsort(component[rows] if i == j else part[rows], kind="stable")
            rows, x = rows[order], x[order]
            ends = np.searchsorted(component[rows], component[rows], side="right") if i == j else None
            first = len(rows) if i == j else int((part[rows] == i).sum())
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for at in range(0, first, 256):
                stop = min(at + 256, first)
                low, high = (at, int(ends[stop - 1])) if i == j else (first, len(rows))
                a, b = rows[at:stop], rows[low:high]
                near = unit[at:stop] @ unit[low:high].T
                hits = (near >= threshold - 1e-9) & (ids[a][:, None] != ids[b]) & (component[a][:, None] == component[b])
                if i == j:
                    hits &= np.arange(at, stop)[:, None] < np.arange(low, high)
                r, c = np.nonzero(hits & (near < threshold + 1e-9))
                hits[r, c] = cosine_at_least(x[at + r], x[low + c], threshold)
                hits = hits.astype(np.float64)
                others[a] += hits @ weight[b]
                others[b] += weight[a] @ hits
        return pa.table({"id": ids, "mark": marks, "others": others.astype(np.int64)})

    return run


def linked(members: DataFrame, stash: Stash, threshold: float) -> DataFrame:
    """(id, mark, others): for each of ``members`` (component, id, mark, n, e) the sum of ``n`` of those of its component with a
    cosine of ``threshold`` or more, all pairs compared. A large component is split into parts, and each pair of parts is a
    task's unit; small ones share buckets."""
    count = members.count()
    size = members.groupBy("component").count().where(F.col("count") > PART)
    rows = F.least(F.greatest(F.col("count") / PARTS, F.lit(PART)), F.lit(8 * PART))
    large = stash.put(size.select("component", F.ceil(F.col("count") / rows).cast("int").alias("parts")))
    small = F.broadcast(large) if large.count() <= LARGE else large.hint("merge")
    dealt = members.join(small, "component", "left").withColumn("large", F.col("parts").isNotNull()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("group", F.when(F.col("large"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(-(-count // BUCKET) or 1))))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    dealt = dealt.select("large", "group", F.explode(meets).alias("meets"), "part", "component", "id", "mark", "n", "e").select("large", "group", "meets.*", "part", "component", "id", "mark", "n", "e")
    return dealt.groupBy("large", "group", "i", "j").applyInArrow(_linked(threshold), "id long, mark long, others long").groupBy("id", "mark").agg(F.sum("others").alias("others"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Equal vectors are one class with its smallest id and are never paired; classes are linked by a cosine of at least
    ``threshold``. Components are those of the pairs found in some pass. ``n_links``: other vectors of the component linked
    directly, copies included; all pairs of a component are compared. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing, and so do vectors of unlike lengths. A row without id links with
    nothing and is kept. Repeated rows each have a row, and count once as a link. No rows give no rows.
    """
    stash = Stash(vectors.sparkSession)
    rows = usable(vectors).distinct()
    # An id may have several vectors: the mark tells them apart.
    classes = stash.put(rows.groupBy("e").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("mark", F.xxhash64("e")))
    links = stash.put(pairs(classes.select("id", "e"), stash, threshold, passes, window, block, bits))
    comps = stash.put(components(links, stash))
    members = stash.put(classes.join(comps.hint("merge"), "id"))
    seen = linked(members, stash, threshold)
    named = classes.join(seen.hint("merge"), ["id", "mark"], "left").join(comps.hint("merge"), "id", "left").select("e", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"))
    members = rows.join(named.hint("merge"), "e").select(F.col("id").alias("vec_id"), "n_links", "c")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(_first(members).hint("merge"), "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _first(members: DataFrame) -> DataFrame:
    """One row for each id: where an id has several vectors, the sum of their links and the smallest component."""
    return members.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("c").alias("c"))
