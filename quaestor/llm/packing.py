"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

In each round, a queue's deficit grows by its share of one token, and a queue whose deficit has come to half a token sends
one, so its deficit falls by one. Windows are runs of what is sent; deficits are carried from window to window, in whichever
partition a window's tokens lie, for as long as all queues last. What a queue has sent after a number of rounds is a closed
form, and so is the place of each token: each document finds its pieces by itself, in any partition, with nothing but its
place in its queue. When a queue runs out, one window takes up what it has, and the others' rounds begin anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm import bpe
from quaestor.llm.common import Held, Stash, frugal, slices

WINDOW = 4096
#: Queues of one round-robin; sources beyond them are mixed by round-robins of their own, whose streams are its last queues.
QUEUES = 64
#: Shares are whole numbers with a sum of about this at most, so that products of two of them fit 64 bits.
SCALE = 1 << 30
#: Rows of (shard, queue) offsets, or of sources, that may be broadcast, some 30 bytes each; beyond it they are joined by a shuffle.
OFFSETS = 1_000_000
#: Tokens whose pieces are found at once; a longer document is cut there as well.
BLOCK = 1 << 16
#: Bytes of text that are encoded at once.
STEP = 1 << 19

Pieces = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Rounds:
    """A round-robin of queues with whole-numbered shares: what they have sent, and where each token comes."""

    def __init__(self, shares: list[int], size: int):
        self.shares, self.total, self.size = np.array(shares, dtype=np.int64), int(sum(shares)), size

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue (column) after each number of rounds (row): rounds * share / total, rounded half up."""
        turns, rest = np.divmod(rounds, self.total)
        return turns[:, None] * self.shares + (2 * rest[:, None] * self.shares + self.total) // (2 * self.total)

    def place(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """How many tokens of all queues are sent before each of these tokens; within a round, queues send in order."""
        share = self.shares[queue]
        turns, rest = np.divmod(token, share)
        rounds = turns * self.total - (-(2 * rest + 1) * self.total // (2 * share))
        before = self.sent(rounds - 1)
        now = self.sent(rounds) - before
        return before.sum(1) + (now * (np.arange(len(self.shares)) < queue[:, None])).sum(1)

    def before(self, window: np.ndarray) -> np.ndarray:
        """Tokens of each queue (column) before each window (row)."""
        want = window * self.size
        rounds = 2 * want - self.sent(want).sum(1)
        while len(high := np.flatnonzero(self.sent(rounds).sum(1) > want)):
            rounds[high] -= 1
        while len(low := np.flatnonzero(self.sent(rounds + 1).sum(1) <= want)):
            rounds[low] += 1
        out = self.sent(rounds)
        now = self.sent(rounds + 1) - out
        return out + (now * (np.cumsum(now, axis=1) <= (want - out.sum(1))[:, None]))


def scaled(wish: list[float]) -> list[int]:
    """Whole numbers in these proportions, with a sum of SCALE at most, or one for each queue more."""
    if all(x == int(x) for x in wish) and sum(wish) <= SCALE:
        return [int(x) for x in wish]
    every = sum(wish)
    return [max(1, int(x / every * SCALE)) if x > 0 else 0 for x in wish]


def schedule(totals: list[int], weights: list[float] | None = None, window: int = WINDOW) -> list[dict]:
    """Phases that use up all queues: first window, each queue's tokens before the phase, and its rounds.

    Weights default to what the queues hold, so that all last to the end. A queue that has run out leaves its share to the
    rest; one of weight 0 sends when no other is left.
    """
    rest, used = np.array(totals, dtype=np.int64), np.zeros(len(totals), dtype=np.int64)
    phases, at = [], 0
    while rest.sum() > 0:
        live = (rest > 0).tolist()
        wish = [w if on else 0 for w, on in zip(weights if weights is not None else rest.tolist(), live, strict=True)]
        rounds = Rounds(scaled(wish if sum(wish) else rest.tolist()), window)
        own = np.flatnonzero(rounds.shares)
        # Up to the window in which a queue's first missing token would lie.
        count = int(rounds.place(own, rest[own]).min()) // window
        if count:
            took = rounds.before(np.array([count]))[0]
        else:
            took, count = np.minimum(rest, rounds.shares * window // rounds.total), 1
            for q in np.argsort(-rounds.shares, kind="stable"):
                took[q] += min(rest[q] - took[q], window - took.sum())
            rounds = Rounds(took.tolist(), int(took.sum()))
        phases.append({"first": at, "base": used.copy(), "rounds": rounds})
        rest, used, at = rest - took, used + took, at + count
    return phases


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the copies: its row, and its number in the row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


class Places:
    """Where the queues' tokens go."""

    def __init__(self, phases: list[dict]):
        self.phases = phases
        self.bases = np.array([p["base"] for p in phases]) if phases else np.zeros((0, 0), np.int64)

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> Pieces:
        """(row, start in the row, length, window, offset in the window) of runs of ``length`` tokens from ``start`` of a queue."""
        bases, end, out = self.bases[:, queue], start + length, []
        low, high = ((bases <= x).sum(0) - 1 for x in (start, end - 1))
        row, phase = _spread(np.where(length > 0, high - low + 1, 0))
        phase += low[row]
        for k in np.unique(phase):
            own = row[phase == k]
            base, rounds, first = bases[k, own], self.phases[k]["rounds"], self.phases[k]["first"]
            till = end[own] if k + 1 == len(bases) else np.minimum(end[own], bases[k + 1, own])
            a, b = np.maximum(start[own] - base, 0), till - base
            some = b > a
            own, base, a, b, q = own[some], base[some], a[some], b[some], queue[own[some]]
            if not len(own):
                continue
            window = rounds.place(q, a) // rounds.size
            at, more = _spread(rounds.place(q, b - 1) // rounds.size - window + 1)
            window = window[at] + more
            known, back = np.unique(np.append(window, window + 1), return_inverse=True)
            before = rounds.before(known)
            this, then = before[back[: len(window)]], before[back[len(window) :]]
            take, q, each = then - this, q[at], np.arange(len(at))
            u, v = np.maximum(a[at], this[each, q]), np.minimum(b[at], then[each, q])
            offset = (np.cumsum(take, axis=1) - take)[each, q] + u - this[each, q]
            some = v > u
            out.append([x[some] for x in (own[at], base[at] + u - start[own[at]], v - u, first + window, offset)])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def plan(totals: list[int], weights: list[float] | None = None, window: int = WINDOW, queues: int = QUEUES) -> tuple[list[tuple[list[dict], int, tuple[int, int] | None]], list[tuple[int, int]]]:
    """(round-robins: phases, window, and the (round-robin, queue) that its stream is; for each source its (round-robin, queue)).

    A round-robin has ``queues`` queues at most. Where there are more sources, the first ones have queues of the root and the
    others, those with a weight apart from those without, are mixed to streams that have the sum of their totals and weights,
    in windows of the tokens that the stream gives to one window above it.
    """
    wish = [float(x) for x in weights] if weights is not None else totals
    plans: list[tuple[list[dict], int, tuple[int, int] | None]] = []
    leaf: list[tuple[int, int]] = [(0, 0)] * len(totals)

    def total(tree) -> tuple[int, float]:
        return (totals[tree], wish[tree]) if isinstance(tree, int) else tuple(map(sum, zip(*map(total, tree), strict=True)))

    def split(own: list[int]) -> list:
        step = -(-len(own) // queues)
        return own if step == 1 else [split(own[a : a + step]) for a in range(0, len(own), step)]

    def add(tree: list, size: int, above: tuple[int, int] | None) -> None:
        sums = [total(t) for t in tree]
        mine, every = len(plans), sum(x[1] for x in sums)
        plans.append((schedule([x[0] for x in sums], None if weights is None else [x[1] for x in sums], size), size, above))
        for slot, (t, (_, part)) in enumerate(zip(tree, sums, strict=True)):
            if isinstance(t, int):
                leaf[t] = (mine, slot)
            else:
                add(t, max(1, round(size * part / every)) if part and every else size, (mine, slot))

    own = [*range(len(totals))]
    if len(own) > queues:
        order = sorted(own, key=lambda q: not wish[q])
        rest = [split(x) for x in ([q for q in order[queues - 2 :] if wish[q]], [q for q in order[queues - 2 :] if not wish[q]]) if x]
        own = order[: queues - 2] + rest
    add(own, window, None)
    return plans, leaf


class Streams:
    """Where sources' tokens go, through all round-robins of a plan."""

    def __init__(self, plans: list[tuple[list[dict], int, tuple[int, int] | None]], leaf: list[tuple[int, int]]):
        self.plans, self.leaf = plans, np.array(leaf, dtype=np.int64).reshape(-1, 2)
        self.places: dict[int, Places] = {}

    def _through(self, k: int, slot: np.ndarray, start: np.ndarray, length: np.ndarray) -> Pieces:
        if k not in self.places:
            self.places[k] = Places(self.plans[k][0])
        row, done, n, window, offset = self.places[k].pieces(slot, start, length)
        if (above := self.plans[k][2]) is None or not len(row):
            return row, done, n, window, offset
        up, more, n, window, offset = self._through(above[0], np.full(len(row), above[1]), window * self.plans[k][1] + offset, n)
        return row[up], done[up] + more, n, window, offset

    def pieces(self, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> Pieces:
        """(row, start in the row, length, window, offset), in order; pieces that lie one after another in a window are one."""
        found = []
        for k in np.unique(self.leaf[source, 0]):
            rows = np.flatnonzero(self.leaf[source, 0] == k)
            row, *rest = self._through(int(k), self.leaf[source[rows], 1], start[rows], length[rows])
            found.append((rows[row], *rest))
        row, done, n, window, offset = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        order = np.lexsort((done, row))
        row, done, n, window, offset = (x[order] for x in (row, done, n, window, offset))
        if not len(row):
            return row, done, n, window, offset
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (window[1:] != window[:-1]) | (offset[1:] != offset[:-1] + n[:-1])))
        return row[first], done[first], np.add.reduceat(n, first), window[first], offset[first]


def _tokens(held, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, totals = bpe.codec(held), TaskContext.get().partitionId(), {}
        tail = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                ids = [x + tail for x in own.encode([x or "" for x in batch.column("text").to_pylist()])]
                starts = []
                for q, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
                    starts.append(totals.get(q, 0))
                    totals[q] = starts[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("queue"), pa.array([shard] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "shard", "place", "doc_tokens", "ids"],
                )

    return run


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _cut(plans: list, leaf: list[tuple[int, int]], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Streams(plans, leaf)
        for whole in batches:
            for batch in slices(whole, "ids", 4 * BLOCK):
                doc, queue, place = (np.asarray(batch.column(c)) for c in ("doc_id", "queue", "place"))
                texts = [memoryview(x.as_buffer()) for x in batch.column("ids")]
                size = np.array([len(x) // 4 for x in texts])
                for at in range(0, int(size.max()), BLOCK):  # one step, but for documents longer than a block
                    rows = np.flatnonzero(size > at)
                    row, start, n, window, offset = places.pieces(queue[rows], place[rows] + at, np.minimum(size[rows] - at, BLOCK))
                    row, start = rows[row], start + at
                    parts = [texts[r][4 * a : 4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
                    columns = [pa.array(doc[row]) if not batch.column("doc_id").null_count else batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, n, np.array([*map(zlib.crc32, parts)], dtype=np.int64), size[row], window, offset))]
                    # Of copies: Arrow never lets go of a memoryview that it has made an array of, nor of the bytes behind it.
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([*map(bytes, parts)], pa.binary())] if with_ids else columns, [*COLUMNS, "ids"] if with_ids else [*COLUMNS])

    return run


def packed(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, weights: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row for each piece of each document.

    A document (doc_id, text, source; other columns are ignored) is its ids by the vocabulary at ``path`` and ``end_id``. All
    sequences but the last hold exactly ``window`` ids. ``weights``: target proportion of each source's tokens, by default the
    source's share of all tokens; a source not named there has weight 0 and is used when the others have run out. Of
    more than QUEUES sources, those with fewest rows are mixed to streams first; what one that has run out leaves goes to its
    stream. A null
    source is a source of its own; a null text is empty and gives the end id alone; rows that repeat an id are documents of
    their own. ``with_ids``: whether the column ids is returned. No rows give no rows.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    # A row for each source; those with most rows come first.
    top = [r[0] for r in docs.groupBy("source").count().orderBy(F.desc("count"), F.asc_nulls_first("source")).collect()]
    if len(top) <= QUEUES:
        queue = F.lit(len(top))
        for k, name in enumerate(top):
            queue = F.when(F.col("source").eqNullSafe(F.lit(name)), k).otherwise(queue)
        docs = docs.withColumn("queue", queue)
    else:
        numbers = spark.createDataFrame([*zip(top, range(len(top)), strict=True)], "name string, queue int")
        docs = docs.join(F.broadcast(numbers) if len(top) <= OFFSETS else numbers.hint("merge"), F.col("source").eqNullSafe(F.col("name")))
    held = Held(spark, bpe.load(path))
    coded = stash.put(docs.select("doc_id", "text", "queue").mapInArrow(frugal(_tokens(held, end_id), model=True), "doc_id long, queue int, shard int, place long, doc_tokens long, ids binary"))
    sums = coded.groupBy("shard", "queue").agg(F.sum("doc_tokens").alias("n"))
    offsets = stash.put(sums.select("shard", "queue", "n", (F.sum("n").over(Window.partitionBy("queue").orderBy("shard")) - F.col("n")).alias("before")))
    by_queue = {r[0]: r[1] for r in offsets.groupBy("queue").agg(F.sum("n")).collect()}
    totals = [by_queue.get(k, 0) for k in range(len(top))]
    wish = None if weights is None else [weights.get(x, 0.0) for x in top]
    plans, leaf = plan(totals, wish, window)
    small = F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets.hint("merge")
    placed = coded.join(small, ["shard", "queue"]).select("doc_id", "queue", (F.col("before") + F.col("place")).alias("place"), "ids")
    schema = ", ".join(f"{c} long" for c in COLUMNS) + (", ids binary" if with_ids else "")
    return placed.mapInArrow(frugal(_cut(plans, leaf, with_ids)), schema)
