"""Near duplicates by min-max hashing: minimum and maximum under each permutation, banded, then confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import Held, Stash, frugal, slices
from quaestor.llm.components import components
from quaestor.llm.kernel import U, mix, shingles, word_hashes
from quaestor.llm.sieve import Sieve

#: 32 bands of 5 values, from 80 permutations: a pair with similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
#: Bytes of text whose words and shingles a worker holds at once.
STEP = 1 << 19


#: Counters of the sketch that orders grams by how common they are.
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS


def signature(grams: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """A row of band keys for each set (sets are not empty). Each permutation gives two values, its minimum and its maximum."""
    rng = np.random.default_rng(seed)
    need = bands * rows
    values = np.empty((len(at) - 1, need + need % 2), dtype=np.uint64)
    half = values.shape[1] // 2
    for k in range(half):
        order = grams * U(int(rng.integers(0, 2**62)) * 2 + 1) + U(int(rng.integers(0, 2**62)))
        order ^= order >> U(31)
        order *= U(0x94D049BB133111EB)
        np.minimum.reduceat(order, at[:-1], out=values[:, k])
        np.maximum.reduceat(order, at[:-1], out=values[:, half + k])
    keys = np.empty((len(values), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(values), U(b + 1))
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + values[:, b * rows + r])
        keys[:, b] = key
    return keys


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                grams, at = shingles(*word_hashes(batch.column("text")), n)
                count = np.diff(at)
                some = np.flatnonzero(count)
                digests = np.zeros((2, len(count)), dtype=np.uint64)
                keys = np.zeros((len(count), bands), dtype=np.uint64)
                if len(some):
                    starts = at[:-1][some]
                    digests[0, some] = np.add.reduceat(mix(grams), starts)
                    digests[1, some] = np.add.reduceat(mix(grams ^ U(0x5851F42D4C957F2D)), starts)
                    keys[some] = signature(grams, np.append(starts, len(grams)), bands, rows)
                held = pa.array(keys.view(np.int64).reshape(-1))
                offsets = np.zeros(len(count) + 1, dtype=np.int32)
                offsets[1:] = np.arange(1, len(count) + 1) * bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(count), *(pa.array(d.view(np.int64)) for d in digests), pa.ListArray.from_arrays(pa.array(offsets), held)], ["doc_id", "n_shingles", "d1", "d2", "bands"]
                )

    return run


def _sets(n: int, wanted: Sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole.filter(wanted.has(whole.column("doc_id"))), "text", STEP):
                grams, at = shingles(*word_hashes(batch.column("text")), n)
                d1 = np.array([mix(grams[a:b]).sum() if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d1.view(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))], ["id", "d1", "grams"])

    return run


def _full(members: DataFrame, docs: DataFrame, n: int, stash: Stash) -> DataFrame:
    """(id, grams): the full sets of these representatives (id, d1). Texts are read again but never shuffled: a filter of the ids, of
    bounded size, lets few others through, and the join is on sets."""
    sets = docs.mapInArrow(frugal(_sets(n, Sieve(members))), "id long, d1 long, grams array<long>").join(members.select("id", F.col("d1").alias("own")).hint("merge"), "id")
    return stash.put(sets.where("d1 = own").dropDuplicates(["id"]).select("id", "grams"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """Those of ``pairs`` (u, v: ids of representatives) whose full shingle sets are similar enough."""
    out = pairs.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("gu")).hint("merge"), "u").join(sets.select(F.col("id").alias("v"), F.col("grams").alias("gv")).hint("merge"), "v")
    both = F.size(F.array_intersect("gu", "gv"))
    return stash.put(out.withColumn("both", both).where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("gu") + F.size("gv") - F.col("both"))).select("u", "v"))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of this partition hold grams of each hash, in chunks."""
    seen = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        grams = np.asarray(batch.column("grams").flatten()).view(np.uint64)
        seen += np.bincount((grams >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
    if seen.any():
        for k, part in enumerate(np.split(np.minimum(seen, 65535).astype(np.uint16), 64)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], ["chunk", "seen"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in table["seen"].to_pylist())
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "seen": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()])})


def _prefixes(held, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        for batch in batches:
            ids, comps = np.asarray(batch.column("id")), np.asarray(batch.column("c"))
            out = []
            for k, grams in enumerate(batch.column("grams")):
                g = np.asarray(grams.values).view(np.uint64)
                n = len(g)
                order = np.lexsort((g, seen[(g >> U(64 - SKETCH_BITS)).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]
                out.append((g[order].view(np.int64), np.arange(len(order)), np.full(len(order), ids[k]), np.full(len(order), n), np.full(len(order), comps[k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["gram", "place", "id", "n", "c"])

    return run


def _between(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs of ``sets`` (id, c, grams) of unlike components c that can be similar enough.

    In any one order of all grams, a similar pair's first common gram lies in the prefix of each set, at places that leave
    room for the overlap that the sizes ask for. Rare grams come first, by a sketch of fixed size that counts hashes; the
    sketch bears on the work, not on the result. At each gram the rows outside its commonest component meet all others.
    """
    seen = np.zeros(SKETCH, dtype=np.uint16)
    for chunk, part in sets.mapInArrow(frugal(_tallied), "chunk int, seen binary").groupBy("chunk").applyInArrow(_summed, "chunk int, seen binary").collect():  # 64 rows
        seen[chunk * (SKETCH // 64) : (chunk + 1) * (SKETCH // 64)] = np.frombuffer(part, dtype=np.uint16)
    rows = sets.mapInArrow(frugal(_prefixes(Held(sets.sparkSession, seen), percent)), "gram long, place long, id long, n long, c long")
    main = rows.groupBy("gram", "c").count().groupBy("gram").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").select("gram", "main")
    rows = rows.join(main.hint("merge"), "gram")
    other = rows.select("gram", F.col("place").alias("place2"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100 + percent))
    met = rows.where("c != main").join(other.hint("merge"), "gram").where((F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("c") < F.col("c2"))))
    met = met.where((F.col("n") - F.col("place") >= need) & (F.col("n2") - F.col("place2") >= need)).where(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    return met.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Links join rows whose sets of distinct ``n``-word shingles have a Jaccard similarity of at least ``percent`` / 100.
    Rows with equal sets are one class, represented by its smallest id, so copies are never paired. In every band bucket the
    smallest id is compared with all others; members of buckets that then still hold several components are compared between
    components too, by an exact prefix join, so no candidate is dropped. ``kept``: the row's id is its component's smallest.

    Null or empty text has an empty set and links with nothing. A row without id links with nothing: component_id is null,
    kept is true. Rows that repeat an id each have a row. No rows give no rows.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stash = Stash(spark)
    signed = stash.put(docs.mapInArrow(frugal(_sign(n, bands, rows)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stash.put(some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")).select("d1", "d2", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), F.col("x.bands").alias("bands")))
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", F.col("hub.id").alias("u"), F.col("hub.n").alias("nu"))
    met = stash.put(banded.join(hubs.hint("merge"), "key").select("u", "nu", "id", "n").distinct())
    # All that share a bucket with others, hubs too; their sets serve both rounds.
    members = stash.put(reps.join(met.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "d1", "bands"))
    sets = _full(members, docs, n, stash)
    star = met.where("id != u").where(f"100 * least(n, nu) >= {percent} * greatest(n, nu)").select("u", F.col("id").alias("v"))
    links = _confirmed(star, sets, percent, stash)
    comps = stash.put(components(links, stash))
    # Buckets that still hold several components: their members are compared between components.
    placed = members.join(comps.hint("merge"), "id", "left").select(F.explode("bands").alias("key"), "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = stash.put(placed.join(mixed.hint("merge"), "key", "left_semi").groupBy("id").agg(F.min("c").alias("c")))
    open_ = stash.put(sets.join(rest.hint("merge"), "id"))
    pairs = _between(open_, percent)
    pairs = stash.put(pairs.join(star.hint("merge"), ["u", "v"], "left_anti"))
    more = _confirmed(pairs, sets, percent, stash)
    stash.drop(rest, open_, pairs, met, members, sets)
    if more.head(1):
        stash.drop(comps)
        comps = stash.put(components(links.unionByName(more), stash))
    named = reps.select("d1", "d2", F.col("id").alias("id")).join(comps.hint("merge"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("c"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named.hint("merge"), ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns; of rows with equal id and text one stays.

    Rows without id stay. Where rows with one id have unlike texts, all stay if one of them is kept.
    """
    found = near_duplicates(docs, n, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    # Rows whose id is repeated or goes: a filter of these ids, of bounded size, spares most other rows the shuffle.
    special = Stash(docs.sparkSession).put(found.where("times > 1 or not kept").select(F.col("doc_id").alias("id"), "kept"))
    asked = Sieve(special)(F.col("doc_id").cast("long"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rest = docs.where(asked).join(special.where("not kept").select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return rest.select(*names).unionByName(docs.where(~asked).select(*names))
