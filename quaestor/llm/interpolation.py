"""Language-model scores by deleted interpolation: n-gram maximum-likelihood estimates are mixed by context-frequency buckets,
with weights learnt by expectation-maximisation on held-out counts.

Counts cross the network once, as sorted blocks of distinct keys: each shard (a run of documents in one partition) sends its
distinct words and word pairs to buckets by hash, each bucket adds the counts up and answers each shard in the shard's own key
order, and the shard, which makes its keys again from its documents, scores them. A key is sent once a shard however often it
occurs there, so no key is hot.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import Stash, fold, forget, partitions, slices
from quaestor.llm.kernel import U, mix, word_hashes

#: Bytes of text in a shard, about.
SHARD = 8 << 20
#: Context-frequency buckets are powers of two of the context's count, up to this one.
LEVELS = 24
#: Steps of the grid, in octaves, on which the held-out counts' estimates are tallied for EM; below 2**-FLOOR they are zero.
GRID, FLOOR = 4, 44
ROUNDS = 60

BEGIN, END = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)  # the context of a text's first token; the token that ends a text


DIFFERS = "a shard's documents differ between two readings; the input must be deterministic"


class Shard:
    """The keys of a run of documents: sorted distinct words (with the end token and the begin context) and word pairs."""

    def __init__(self, words: np.ndarray, at: np.ndarray, learn: np.ndarray, deleted: np.ndarray):
        count = np.diff(at)
        ends = at[1:] + np.arange(len(count))  # places of end tokens, one for each document
        self.tokens = np.empty(len(words) + len(count), dtype=np.uint64)
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[ends] = False
        self.tokens[inner], self.tokens[ends] = words, END
        self.starts, self.sizes = ends - count, count + 1
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = BEGIN
        self.document = np.repeat(np.arange(len(count)), self.sizes)
        self.words, self.word = np.unique(np.append(self.tokens, BEGIN), return_inverse=True)
        self.begin, self.word = self.word[-1], self.word[:-1]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = self.begin
        code = self.context << 32 | self.word
        codes, self.pair = np.unique(code, return_inverse=True)
        self.pairs = mix(self.words[codes >> 32] * U(0x9E3779B97F4A7C15) + self.words[codes & 0xFFFFFFFF])
        # Counts of learning tokens: of all documents to learn from, and of those without the deleted part.
        tell = lambda which, n, flag: np.bincount(which[flag[self.document]], minlength=n)
        kept = learn & ~deleted
        self.counts = []
        for which, n in ((self.word, len(self.words)), (self.pair, len(self.pairs))):
            self.counts.append((tell(which, n, learn), tell(which, n, kept)))
        for (counts, flag) in zip(self.counts[0], (learn, kept), strict=True):
            counts[self.begin] = int(flag.sum())
        # The order in which keys are sent, and their buckets' borders.
        self.orders = [np.argsort(k, kind="stable") for k in (self.words, self.pairs)]

    def borders(self, kind: int, buckets: int) -> np.ndarray:
        """Where each bucket begins among the sorted keys: buckets are equal ranges of the hash."""
        keys = (self.words, self.pairs)[kind][self.orders[kind]]
        edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
        return np.append(np.searchsorted(keys, edges), len(keys))

    def place(self, kind: int, answers: list[tuple[int, np.ndarray]], buckets: int) -> np.ndarray:
        """Buckets' answers (columns) in the order of the shard's own keys; there must be one for each bucket with keys."""
        border = self.borders(kind, buckets)
        if sorted(b for b, _ in answers) != [b for b in range(buckets) if border[b + 1] > border[b]]:
            raise RuntimeError(DIFFERS)
        out = np.zeros((2, len(self.orders[kind])), dtype=np.int64)
        for b, table in answers:
            if table.shape[1] != border[b + 1] - border[b]:
                raise RuntimeError(DIFFERS)
            out[:, self.orders[kind][border[b] : border[b + 1]]] = table
        return out

    def digest(self) -> int:
        """A number that tells the shard's keys and their counts from others'."""
        a, b = 0, 1
        for kind, keys in enumerate((self.words, self.pairs)):
            for x in (keys, *self.counts[kind]):
                a, b = zlib.crc32(x, a), zlib.adler32(x, b)
        return a | b << 31


def packed_counts(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest of three widths."""
    top = int(x.max()) if x.size else 0
    kind = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "Q"
    return kind.encode() + x.astype({"B": np.uint8, "H": np.uint16, "Q": np.uint64}[kind]).tobytes()


def unpacked_counts(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype={66: np.uint8, 72: np.uint16, 81: np.uint64}[x[0]], offset=1).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are all but empty and compress away."""
    return np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1))


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[pa.RecordBatch], Shard]]:
    """(shard, rows, keys): runs of a partition's rows of about ``size`` bytes of text; the same whenever it is read again."""
    part, number, held, words, at, bytes_ = TaskContext.get().partitionId(), 0, [], [], [np.zeros(1, np.int64)], 0

    def made() -> tuple[int, list[pa.RecordBatch], Shard]:
        learn, deleted = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("learn", "deleted"))
        return part << 32 | number, held, Shard(np.concatenate(words), np.concatenate(at), learn, deleted)

    for whole in batches:
        for batch in slices(whole, "text"):
            h, a = word_hashes(batch.column("text"))
            held.append(batch.select([c for c in batch.schema.names if c != "text"]))
            words.append(h)
            at.append(a[1:] + at[-1][-1])
            bytes_ += batch.column("text").nbytes
            if bytes_ >= size:
                yield made()
                number, held, words, at, bytes_ = number + 1, [], [], [np.zeros(1, np.int64)], 0
    if held:
        yield made()


def _sent(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for shard, _, own in _shards(batches, size):
            digest = own.digest()
            for kind, keys in enumerate((own.words, own.pairs)):
                order, border = own.orders[kind], own.borders(kind, buckets)
                keys, (learn, kept) = keys[order], own.counts[kind]
                learn, kept = learn[order], kept[order]
                some = [b for b in range(buckets) if border[b + 1] > border[b]]
                parts = [slice(border[b], border[b + 1]) for b in some]
                columns = [some, [kind] * len(some), [shard] * len(some), [digest] * len(some), *([f(x) for x in parts] for f in (lambda x: packed_keys(keys[x]), lambda x: packed_counts(learn[x]), lambda x: packed_counts(learn[x] - kept[x])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "shard", "digest", "keys", "learn", "deleted"])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """Adds up a bucket's counts. Answers each shard with the totals of its keys; shard -1 gets the bucket's own totals."""
    bucket, kind = table["bucket"][0].as_py(), table["kind"][0].as_py()
    shards, digests = table["shard"].to_pylist(), table["digest"].to_pylist()
    keys = [unpacked_keys(x) for x in table["keys"].to_pylist()]
    ends = np.cumsum([0, *map(len, keys)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    learn = np.bincount(place, weights=np.concatenate([unpacked_counts(x) for x in table["learn"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
    deleted = np.bincount(place, weights=np.concatenate([unpacked_counts(x) for x in table["deleted"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
    token = distinct != BEGIN if kind == 0 else np.zeros(len(distinct), bool)
    known, left = (learn > 0) & token, (learn > deleted) & token
    sums = np.array([learn[token].sum(), known.sum(), (learn - deleted)[token].sum(), left.sum()], dtype=np.int64)
    rows = [(bucket, kind, -1, 0, sums.tobytes(), b"")] + [(bucket, kind, s, x, packed_counts(learn[place[a:b]]), packed_counts(deleted[place[a:b]])) for s, x, a, b in zip(shards, digests, ends[:-1], ends[1:], strict=True)]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "shard", "digest", "learn", "deleted"])


def level(count: np.ndarray) -> np.ndarray:
    """The context-frequency bucket: 0 for unseen contexts, else one more than the power of two that the count reaches."""
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), LEVELS - 1)


def _grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.round(-np.log2(np.maximum(p, 2.0**-FLOOR)) * GRID).astype(np.int64), FLOOR * GRID - 1), FLOOR * GRID)


def learn_weights(tally: np.ndarray, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (level, [pair, word, uniform]) by expectation-maximisation; ``tally``: rows of (level, pair step, word step, n)."""
    back = lambda x: np.where(x == FLOOR * GRID, 0.0, 2.0 ** (-x / GRID))
    weights = np.tile([0.4, 0.5, 0.1], (LEVELS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if not len(tally):
        return weights
    which, n = tally[:, 0], tally[:, 3].astype(float)
    p = np.stack([back(tally[:, 1]), back(tally[:, 2]), np.full(len(tally), 1 / (vocabulary + 1))], axis=1)
    for _ in range(rounds):
        share = weights[which] * p
        share *= (n / share.sum(1))[:, None]
        # A token of each part in proportion, so that no weight that may be needed is zero.
        total = np.stack([np.bincount(which, share[:, k], minlength=LEVELS) for k in range(3)], axis=1) + np.array([0.01, 0.1, 0.01])
        total[0, 0] = 0
        weights = total / total.sum(1, keepdims=True)
    return weights


class _Answers:
    """What a shard got back: word and pair counts in the order of its own keys."""

    def __init__(self, own: Shard, rows: list[tuple[int, int, bytes, bytes]], buckets: int):
        by_kind: list[list[tuple[int, np.ndarray]]] = [[], []]
        for bucket, kind, learn, deleted in rows:
            by_kind[kind].append((bucket, np.stack([unpacked_counts(learn), unpacked_counts(deleted)])))
        self.words, self.pairs = (own.place(kind, by_kind[kind], buckets) for kind in (0, 1))


def _documents(size: int, buckets: int):
    """A shard's rows and keys, compressed, to meet its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for shard, rows, own in _shards(batches, size):
            ids = [x for b in rows for x in b.column("doc_id").to_pylist()]
            flags = [np.concatenate([np.asarray(b.column(c)) for b in rows]) for c in ("learn", "deleted")]
            body = (ids, *flags, own.sizes, packed_keys(own.words), planes(own.word))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(body)], pa.binary())], ["shard", "body"])

    return run


def planes(x: np.ndarray) -> bytes:
    """Non-negative integers below 2**32, compressed byte plane by byte plane."""
    return zlib.compress(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)


def _opened(body: bytes) -> tuple[list, np.ndarray, np.ndarray, Shard]:
    ids, learn, deleted, sizes, words, word = pickle.loads(body)
    tokens = unpacked_keys(words)[unplanes(word)]
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(tokens), dtype=bool)
    inner[ends] = False
    return ids, learn, deleted, Shard(tokens[inner], np.cumsum([0, *(sizes - 1)]), learn, deleted)


def _rows(answers: pa.Table) -> list[tuple[int, int, bytes, bytes]]:
    return [*zip(*(answers[c].to_pylist() for c in ("bucket", "kind", "learn", "deleted")), strict=True)]


MET = "level long, pair long, word long, n long, body binary"


def _met(buckets: int, kept_tokens: int):
    """Two kinds of rows of a shard. Of its deleted documents: how often each context level meets each pair of estimates that
    the rest of the counts gives. Of all documents: the counts of each token and of its pair, to score when weights are known."""

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        tally, body = np.zeros((0, 4), dtype=np.int64), []
        if not documents.num_rows:
            raise RuntimeError(DIFFERS)  # the second reading has lost a shard
        ids, learn, deleted, own = _opened(documents["body"][0].as_py())
        if {*answers["digest"].to_pylist()} != {own.digest()}:
            raise RuntimeError(DIFFERS)
        got = _Answers(own, _rows(answers), buckets)
        use = (learn & deleted)[own.document]
        if use.any():
            words, pairs = got.words[0] - got.words[1], got.pairs[0] - got.pairs[1]
            c12, c1, c2 = pairs[own.pair[use]], words[own.context[use]], words[own.word[use]]
            key = (level(c1) * (FLOOR * GRID + 1) + _grid(c12 / np.maximum(c1, 1))) * (FLOOR * GRID + 1) + _grid(c2 / max(kept_tokens, 1))
            key, n = np.unique(key, return_counts=True)
            tally = np.stack([key // (FLOOR * GRID + 1) ** 2, key // (FLOOR * GRID + 1) % (FLOOR * GRID + 1), key % (FLOOR * GRID + 1), n], axis=1)
        body = [pickle.dumps((ids, learn, own.sizes, int(got.words[0][own.begin]), _wide(got.words[0][own.word]), _wide(got.pairs[0][own.pair])))]
        columns = [pa.array([*tally[:, k].tolist(), *[None] * len(body)], pa.int64()) for k in range(4)]
        return pa.table([*columns, pa.array([None] * len(tally) + body, pa.binary())], names=["level", "pair", "word", "n", "body"])

    return run


def _wide(x: np.ndarray) -> list[bytes]:
    return [planes(x & 0xFFFFFFFF), planes(x >> 32)]


def _unwide(x: list[bytes]) -> np.ndarray:
    return unplanes(x[0]) | unplanes(x[1]) << 32


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(tokens: int, distinct: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                ids, learn, sizes, begun, words, pairs = pickle.loads(body.as_py())
                c2, c12 = _unwide(words), _unwide(pairs)
                starts = np.cumsum(sizes) - sizes
                c1 = np.append(begun, c2[:-1])
                c1[starts] = begun
                w = weights[level(c1)]
                p = w[:, 0] * (c12 / np.maximum(c1, 1)) + w[:, 1] * (c2 / max(tokens, 1)) + w[:, 2] / (distinct + 1)
                base = np.log10((c2 + 0.5) / (tokens + 0.5 * (distinct + 1)))
                known, base, score = (np.add.reduceat(x, starts) for x in ((c2 > 0).astype(np.int64), base, np.log10(p)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(~learn), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)], [x.split()[0] for x in SCORED.split(", ")])

    return run


def scored(docs: DataFrame, learn, deleted, size: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    ``learn`` and ``deleted``: boolean columns over doc_id. The model learns from the rows of ``learn``; for its weights, those
    of them that are ``deleted`` are held out from the counts. Tokens are the words and one end a text; the estimates are of a
    word after the word before it, of a word, and uniform over the V known words and one unknown. A null text is empty; rows
    that repeat an id each have a row. Where nothing can be learnt, all tokens are unknown. No rows give no rows. ``docs`` must
    give the same rows in the same partitions when read again; a shard that differs is an error. Words and pairs are told apart by
    64-bit hashes, n_known among them.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    buckets = 2 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), learn.alias("learn"), deleted.alias("deleted"))
    sent = rows.mapInArrow(_sent(size, buckets), "bucket int, kind int, shard long, digest long, keys binary, learn binary, deleted binary")
    answers = stash.put(sent.groupBy("bucket", "kind").applyInArrow(_answered, "bucket int, kind int, shard long, digest long, learn binary, deleted binary"))
    sums = np.zeros(4, dtype=np.int64)
    for row in answers.where("shard = -1 and kind = 0").select("learn").collect():  # 32 bytes a bucket
        sums += np.frombuffer(row[0], dtype=np.int64)
    tokens, distinct, kept_tokens, kept_distinct = (int(x) for x in sums)
    answers = answers.where("shard >= 0")
    bodies = rows.mapInArrow(_documents(size, buckets), "shard long, body binary")
    met = stash.put(bodies.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_met(buckets, kept_tokens), MET))
    tally = met.where("body is null").groupBy("level", "pair", "word").agg(F.sum("n").alias("n"))
    found = np.array([tuple(r) for r in tally.collect()], dtype=np.int64).reshape(-1, 4)  # bounded by the grid
    weights = learn_weights(found, kept_distinct)
    out = met.where("body is not null").select("body").mapInArrow(_scored(tokens, distinct, weights), SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def scored_by_folds(docs: DataFrame) -> DataFrame:
    """``scored`` with five folds by the id: fold 1 is not learnt from, fold 4 is deleted."""
    return scored(docs, fold("doc_id", 5) != 1, fold("doc_id", 5) == 4)
