"""Approximate nearest neighbours by balanced posting lists: boundary vectors are replicated to several clusters, centroids are
searched by an in-memory graph, and a distance ratio selects the lists of a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.llm.common import Held, Stash
from quaestor.llm.projections import matrix, usable

#: Wanted rows of a list, and lists at most, which bounds the broadcast graph (beyond it, lists grow and are split over tasks).
LIST, LISTS = 256, 32_768
#: Vectors that the centroids are fitted on: so many for each list, SAMPLE at least, as far as CELLS components go.
FITTED, SAMPLE, CELLS = 16, 20_000, 1 << 25
#: Centroids that one run of Lloyd's rounds makes; more come of splitting its clusters.
FLAT = 256
#: A vector joins the lists of up to REPLICAS centroids within CLOSURE times its nearest one's distance.
REPLICAS, CLOSURE = 3, 1.1
#: A query visits the lists whose centroid is within RATIO times the nearest one's distance, and as many as hold LEAST rows. The
#: search has BEAM places, and more where all of them are within the ratio.
RATIO, BEAM, LEAST = 1.17, 64, 1024
#: Rows, and queries, that one task compares, about.
GROUP, QUERIES = 16_384, 4_096
DEGREE, ENTRIES = 24, 32


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    lengths, step = (centres**2).sum(1), max(64, (1 << 22) // len(centres))
    return np.concatenate([np.argmin(lengths - 2 * x[a : a + step] @ centres.T, axis=1) for a in range(0, len(x), step)])


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """Up to k centroids of the rows of x by Lloyd's rounds; those left empty go."""
    if k <= 1 or len(x) <= 1:
        return x.mean(0, keepdims=True)
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        centres = means(x, nearest_centre(x, centres))
    return np.unique(centres, axis=0)


def means(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The mean of each cluster that has rows."""
    order = np.argsort(near, kind="stable")
    first = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1]))
    return np.add.reduceat(x[order], first) / np.diff(first, append=len(x))[:, None]


def fit(x: np.ndarray, k: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """About k centroids of the rows of x whose clusters are of like size: in each round a cluster of twice the mean size or more
    is split by its own rows into parts of that size, and one of less than a quarter goes to its neighbours. Where k is large,
    FLAT coarse clusters come first, so that no run has more than some hundreds of centroids."""
    rng, mean = np.random.default_rng(seed), len(x) / max(k, 1)
    centres = lloyd(x, min(k, FLAT), rng)
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        count = np.bincount(near, minlength=len(centres))
        large = np.flatnonzero(count >= 2 * mean)
        if not len(large) or k <= 1:
            break
        order, ends = np.argsort(near, kind="stable"), np.cumsum(count)
        parts = [lloyd(x[order[ends[c] - count[c] : ends[c]]], min(FLAT, -(-count[c] // max(1, round(mean)))), rng) for c in large]
        centres = np.unique(np.concatenate([centres[(count < 2 * mean) & (count >= mean / 4)], *parts]), axis=0)
    return means(x, nearest_centre(x, centres))


class Graph:
    """Centroids, each joined to its nearest ones and to some at random, so that a search from shared entries reaches all regions."""

    def __init__(self, centres: np.ndarray, degree: int = DEGREE, seed: int = 6):
        self.centres, self.lengths = centres, (centres**2).sum(1)
        rng, k = np.random.default_rng(seed), len(centres)
        near = np.empty((k, min(degree, k)), dtype=np.int32)
        for a in range(0, k, 1024):
            d = self.lengths - 2 * centres[a : a + 1024] @ centres.T
            near[a : a + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        # What has another as a near one is joined to it as well, as far as there is room; the rest is chance.
        back = rng.integers(0, k, (k, 8), dtype=np.int32)
        source, target = np.repeat(np.arange(k, dtype=np.int32), near.shape[1]), near.reshape(-1)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        back[target[place < 4], place[place < 4]] = source[place < 4]
        # Links that chance has made twice lead back to the centroid itself.
        self.links = np.sort(np.concatenate([near, back], axis=1), axis=1)
        again = np.zeros(self.links.shape, dtype=bool)
        again[:, 1:] = self.links[:, 1:] == self.links[:, :-1]
        self.links = np.where(again, np.arange(k, dtype=np.int32)[:, None], self.links)
        self.entries = np.sort(rng.choice(k, min(ENTRIES, k), replace=False))

    def near(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the centroids, nearest first, that a best-first search with ``beam`` places ends with (-1 where
        there are fewer), and their distances; all rows are searched at once."""
        rows, k = len(x), len(self.centres)
        beam = min(beam, k)
        lengths = (x**2).sum(1)
        seen = np.zeros((rows, k), dtype=bool)
        seen[:, self.entries] = True
        ids = np.full((rows, beam + len(self.entries)), -1, dtype=np.int64)
        dist = np.full(ids.shape, np.inf)
        ids[:, beam:] = self.entries
        dist[:, beam:] = self.lengths[self.entries] - 2 * x @ self.centres[self.entries].T
        opened = np.zeros(ids.shape, dtype=bool)
        live = np.arange(rows)
        while len(live):
            # The beam's nearest places; a place that has not been opened is opened next.
            keep = np.argsort(dist[live], axis=1, kind="stable")[:, :beam]
            own_ids, own_dist, own_open = (np.take_along_axis(t[live], keep, axis=1) for t in (ids, dist, opened))
            todo = ~own_open & np.isfinite(own_dist)
            first, some = np.argmax(todo, axis=1), todo.any(axis=1)
            own_open[some, first[some]] = True
            ids[live, :beam], dist[live, :beam], opened[live, :beam] = own_ids, own_dist, own_open
            dist[live, beam:] = np.inf
            live, go = live[some], own_ids[some, first[some]]
            if not len(live):
                break
            fresh = self.links[go]
            if fresh.shape[1] > ids.shape[1] - beam:
                more = fresh.shape[1] - (ids.shape[1] - beam)
                ids, dist, opened = np.pad(ids, ((0, 0), (0, more)), constant_values=-1), np.pad(dist, ((0, 0), (0, more)), constant_values=np.inf), np.pad(opened, ((0, 0), (0, more)))
            d = self.lengths[fresh] - 2 * np.einsum("rd,rkd->rk", x[live], self.centres[fresh])
            d[seen[live[:, None], fresh]] = np.inf
            seen[live[:, None], fresh] = True
            ids[live, beam : beam + fresh.shape[1]], dist[live, beam : beam + fresh.shape[1]], opened[live, beam : beam + fresh.shape[1]] = fresh, d, False
        ids, dist = ids[:, :beam], dist[:, :beam]
        ids[~np.isfinite(dist)] = -1
        return ids, np.sqrt(np.maximum(dist + lengths[:, None], 0))

    def owners(self, x: np.ndarray, closure: float, replicas: int) -> np.ndarray:
        """For each row of x up to ``replicas`` centroids (-1 where fewer): the nearest, and those about as near that lie nearer
        to the row than to any centroid taken before, so that replicas lie on different sides."""
        ids, dist = self.near(x, 4 * replicas)
        out = np.full((len(x), replicas), -1, dtype=np.int64)
        out[:, 0], taken = ids[:, 0], np.ones(len(x), dtype=np.int64)
        for j in range(1, ids.shape[1]):
            fine = (ids[:, j] >= 0) & (dist[:, j] <= closure * dist[:, 0]) & (taken < replicas)
            for r in range(replicas):
                old = np.flatnonzero(fine & (out[:, r] >= 0))
                apart = ((self.centres[out[old, r]] - self.centres[ids[old, j]]) ** 2).sum(1) > dist[old, j] ** 2
                fine[old[~apart]] = False
            own = np.flatnonzero(fine)
            out[own, taken[own]] = ids[own, j]
            taken[own] += 1
        return out

    def visits(self, x: np.ndarray, sizes: np.ndarray, ratio: float, least: int) -> list[np.ndarray]:
        """For each row of x the lists to look through: those within ``ratio`` times the nearest one's distance, then the next
        nearest, all of them in the end, until they hold ``least`` rows."""
        ids, dist = self.near(x, BEAM)
        beam, kept = BEAM, [*zip(ids, dist, strict=True)]
        wide = np.arange(len(x))
        while beam < len(self.centres):
            wide = wide[np.array([bool(kept[k][1][-1] <= ratio * kept[k][1][0]) for k in wide], dtype=bool)]
            if not len(wide):
                break
            beam *= 4
            for k, own in zip(wide.tolist(), zip(*self.near(x[wide], beam), strict=True), strict=True):
                kept[k] = own
        out = []
        for k, (ids, dist) in enumerate(kept):
            found = ids[ids >= 0]
            held = np.cumsum(sizes[found])
            n = max(int((dist[: len(found)] <= ratio * dist[0]).sum()), int(np.searchsorted(held, least)) + 1)
            own = found[:n]
            if held[-1] < least and n > len(found):
                rest = np.setdiff1d(np.flatnonzero(sizes), own)
                rest = rest[np.argsort(((self.centres[rest] - x[k]) ** 2).sum(1), kind="stable")]
                own = np.concatenate([own, rest[: int(np.searchsorted(held[-1] + np.cumsum(sizes[rest]), least)) + 1]])
            out.append(own[sizes[own] > 0])
        return out


def _assigned(held, closure: float, replicas: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = held.made(Graph)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                own = graph.owners(matrix(batch.column("e")), closure, replicas)
                rows, place = np.nonzero(own >= 0)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(own[rows, place].astype(np.int32)), kept.column("id"), kept.column("e")], ["list", "id", "e"])

    return run


def _visits(held, sizes: np.ndarray, groups: list[list[int]], ratio: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = held.made(Graph)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, group, lists = [], [], []
                for k, own in enumerate(graph.visits(matrix(batch.column("e")), sizes, ratio, least)):
                    by_group: dict[int, list[int]] = {}
                    for c in own.tolist():
                        for g in groups[c]:
                            by_group.setdefault(g, []).append(c)
                    rows += [k] * len(by_group)
                    group += by_group.keys()
                    lists += by_group.values()
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), kept.column("id"), kept.column("e"), pa.array(lists, pa.list_(pa.int32()))], ["group", "id", "e", "lists"])

    return run


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): all rows of x, other than the query's own id, that can be among a query's ``k`` nearest distinct
    ids, as far as these rows go. One matrix product finds them; they are measured on the original vectors."""
    near = (x**2).sum(1) - 2 * q @ x.T
    near[q_ids[:, None] == ids] = np.inf
    # Entries of one id may take each other's places.
    last = min(k + len(ids) - len(np.unique(ids)), len(ids)) - 1
    margin = 1e-9 * ((x**2).sum(1).max() + (q**2).sum(1))
    bound = np.partition(near, last, axis=1)[:, last] + margin
    a, b = np.nonzero((near <= bound[:, None]) & np.isfinite(near))
    return a, ids[b], np.sqrt(((x[b] - q[a]) ** 2).sum(1))


def best(a: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` nearest distinct ids, ties to the smaller id."""
    order = np.lexsort((d, ids, a))
    order = order[np.append(True, (a[order][1:] != a[order][:-1]) | (ids[order][1:] != ids[order][:-1]))] if len(order) else order
    order = order[np.lexsort((ids[order], d[order], a[order]))]
    return order[np.arange(len(order)) - np.searchsorted(a[order], a[order]) < k]


def _searched(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        q_ids = np.asarray(queries["id"])
        if queries.num_rows and rows.num_rows:
            q, x, ids, lists = matrix(queries["e"].combine_chunks()), matrix(rows["e"].combine_chunks()), np.asarray(rows["id"]), np.asarray(rows["list"])
            asked = queries["lists"].combine_chunks()
            who, wanted = np.repeat(np.arange(len(asked)), np.diff(np.asarray(asked.offsets))), np.asarray(asked.flatten())
            order, by = np.argsort(lists, kind="stable"), np.argsort(wanted, kind="stable")
            x, ids, lists, who, wanted = x[order], ids[order], lists[order], who[by], wanted[by]
            # Each list of the group meets the queries that look through it.
            for c in np.unique(wanted):
                a, b = np.searchsorted(lists, [c, c + 1])
                own = who[slice(*np.searchsorted(wanted, [c, c + 1]))]
                for at in range(0, len(own) if b > a else 0, 256):
                    part = own[at : at + 256]
                    r, i, d = nearest(q[part], q_ids[part], x[a:b], ids[a:b], k)
                    found.append((part[r], i, d))
        a, i, d = (np.concatenate(c) for c in zip(*found, strict=True))
        top = best(a, i, d, k)
        return pa.table({"query_id": q_ids[a[top]], "vec_id": i[top], "score": d[top]})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, ratio: float = RATIO, closure: float = CLOSURE, replicas: int = REPLICAS, length: int = LIST, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` found for each of ``queries`` (both vec_id, embedding).

    Score: Euclidean distance in double precision on the original vectors; nearest first, ties to the smaller id; a query's own
    id is no candidate. Centroids are fitted on a sample by hash of the id, one for each ``length`` rows and LISTS at most; all
    rows are indexed. Of rows with equal vectors the k + 1 smallest ids stand for all, since ties go to the smaller id, so
    copies make no list long. A list longer than a task's share is split over tasks, and so are a group's queries. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without id, take no part; nor do vectors of
    another length than the most. Repeated rows count once; where an id has several vectors, its nearest counts, and the least
    is the query. No vectors or no queries give no rows.
    """
    spark: SparkSession = vectors.sparkSession
    stash = Stash(spark)
    copies = Window.partitionBy("e").orderBy("id")
    rows = stash.put(usable(vectors).distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    size = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    rows, count = rows.where(F.size("e") == size["n"]), size["count"]
    wanted = max(1, min(LISTS, count // length))
    fitted = min(max(SAMPLE, FITTED * wanted), max(1024, CELLS // size["n"]))
    rate = min(1.0, fitted / count)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(rate * (1 << 30))).toArrow().sort_by([("id", "ascending")])
    if not sample.num_rows:
        sample = rows.limit(1).toArrow()
    # The sample's order must not hang on files' order, nor that on ids with several vectors.
    x = matrix(sample["e"].combine_chunks())
    held = Held(spark, fit(x[np.lexsort((x[:, 0], np.asarray(sample["id"])))], wanted))
    posted = stash.put(rows.mapInArrow(_assigned(held, closure, replicas), "list int, id long, e array<double>"))
    sizes = np.zeros(len(held.value), dtype=np.int64)
    for c, n in posted.groupBy("list").count().collect():  # a row for each list, LISTS at most
        sizes[c] = n
    # Lists lie one after another, by their centroids' order, and are cut to groups of GROUP rows; longer ones have several groups.
    begin = np.cumsum(sizes) - sizes
    first = begin // GROUP
    parts = np.maximum(1, -(-sizes // GROUP))
    groups = [[int(g) for g in range(f, f + n)] for f, n in zip(first.tolist(), parts.tolist(), strict=True)]
    lists = spark.createDataFrame([(c, int(f), int(n)) for c, (f, n) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int")
    asked = usable(queries).where(F.size("e") == size["n"]).groupBy("id").agg(F.min("e").alias("e"))
    asked = stash.put(asked.mapInArrow(_visits(held, sizes, groups, ratio, max(least, replicas * (k + 1))), "group int, id long, e array<double>, lists array<int>"))
    # A group with many queries is given to several tasks.
    shares = asked.groupBy("group").count().select("group", F.ceil(F.col("count") / QUERIES).cast("int").alias("shares"))
    dealt = posted.join(F.broadcast(lists), "list").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("group"), "list", "id", "e")
    dealt = dealt.join(shares.hint("shuffle_hash"), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "list", "id", "e")
    asked = asked.join(shares.hint("shuffle_hash"), "group").select("group", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "e", "lists")
    found = asked.groupBy("group", "share").cogroup(dealt.groupBy("group", "share")).applyInArrow(_searched(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return top.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
