"""Language identification by prediction by partial matching: per-language byte context trees with escapes, frozen after
training, give the exact code length of a text; the shortest wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.bpe import Lookup
from quaestor.llm.common import Held, as_before, frugal, slices, with_rest
from quaestor.llm.kernel import utf8

#: Training rows for each language (by hash of the id, whole texts of any length), and the order of the trees.
ROWS, ORDER = 400, 3
#: Code lengths that a worker remembers, over all languages; when it has more, it begins anew.
CELLS = 1 << 22
#: Bytes of text whose runs and code lengths a worker holds at once.
STEP = 1 << 19
UNKNOWN = "und"
#: Bits of a byte that is not coded at all.
PLAIN = 8.0

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def runs(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, A-Z lower-cased, the number that it and the ``order`` bytes before it make (spaces before a
    text's first one); and the n + 1 offsets of the texts."""
    data, at = utf8(texts)
    s = _fold[data].astype(np.int64)
    place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
    out = s.copy()
    for k in range(1, order + 1):
        before = np.full(len(s), 32, dtype=np.int64)
        before[k:] = s[:-k]
        before[place < k] = 32
        out |= before << (8 * k)
    return out, at


class Tree:
    """One language's contexts of up to ``order`` bytes, from how often each run of order + 1 bytes occurs.

    In a context with n occurrences and u distinct bytes, a byte seen c times costs -log2(c / (n + u)) and an escape
    -log2(u / (n + u)); after an escape the shorter context counts only bytes that the longer one did not have. Bytes never seen
    at all share what is left alike.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.pairs, self.seen, self.contexts, self.escape, self.open, self.on = [], [], [], [], [], []
        for k in range(order + 1):
            pairs, where = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.bincount(where, counts, len(pairs)).astype(np.int64)
            contexts, own = np.unique(pairs >> 8, return_inverse=True)
            n, u = np.bincount(own, seen, len(contexts)), np.bincount(own, minlength=len(contexts))
            if k:
                # What the shorter context has left when this one's bytes are left out.
                up = np.searchsorted(self.contexts[-1], contexts & ((1 << 8 * (k - 1)) - 1))
                taken = np.bincount(own, self.seen[-1][np.searchsorted(self.pairs[-1], pairs & ((1 << 8 * k) - 1))], len(contexts))
                n_up, u_up = self._n[up] - taken, self._u[up] - u
                self.open.append(np.log2(np.maximum(n_up + u_up, 1)))
                self.on.append(np.where(u_up > 0, -np.log2(np.maximum(u_up, 1) / np.maximum(n_up + u_up, 1)), 0.0))
            else:
                self.open.append(np.zeros(len(contexts)))
                self.on.append(np.zeros(len(contexts)))
            self._n, self._u = n, u
            self.pairs.append(pairs)
            self.seen.append(seen)
            self.contexts.append(contexts)
            self.escape.append((np.log2(n + u), -np.log2(u / (n + u))))
        self.floor = float(np.log2(max(256 - len(self.pairs[0]), 1)))

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run after the bytes before it."""
        out, came = np.zeros(len(codes)), np.full(len(codes), -1)  # came: the longer context that was escaped from
        going, begun = np.ones(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
        for k in range(self.order, -1, -1):
            pair, context = codes & ((1 << 8 * (k + 1)) - 1), codes >> 8 & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            where = np.minimum(np.searchsorted(self.pairs[k], pair), len(self.pairs[k]) - 1)
            hit = self.pairs[k][where] == pair
            bits = np.log2(self.seen[k][where])
            total, escape = self.escape[k]
            first, later = going & known & ~begun, going & begun
            out[first] += np.where(hit, total[at] - bits, escape[at])[first]
            if k < self.order and later.any():
                out[later] += np.where(hit[later], self.open[k + 1][came[later]] - bits[later], self.on[k + 1][came[later]])
            begun |= first
            came = np.where(begun, at, came)
            going &= ~(begun & hit)
        out[going] += self.floor
        return out


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        self.trees = [Tree(*counts[k], order) for k in self.langs]
        self._forget()

    def _forget(self) -> None:
        self.known, self.keys, self.costs = Lookup(np.zeros(0, np.uint64)), np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """For each run the row of ``costs`` that holds its code lengths."""
        keys = codes.astype(np.uint64)
        row = self.known.get(keys)
        if (row < 0).any():
            fresh = np.unique(keys[row < 0])
            if (len(self.keys) + len(fresh)) * len(self.langs) > CELLS:
                self._forget()
                fresh = np.unique(keys)
            self.costs = np.concatenate([self.costs, np.stack([t.lengths(fresh.astype(np.int64)) for t in self.trees], axis=1)])
            old, self.keys = len(self.keys), np.append(self.keys, fresh)
            if 2 * len(self.keys) > len(self.known.at):
                self.known = Lookup(self.keys)
            else:
                self.known.put(fresh, np.arange(old, len(self.keys)))
            row = self.known.get(keys)
        return row

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each row under each language; rows begin in a context of spaces."""
        codes, at = runs(texts, self.order)
        out = np.zeros((len(at) - 1, len(self.langs)))
        # A step's bytes times languages are bounded; a text may take several steps.
        step = max(1024, (1 << 22) // len(self.langs))
        for a in range(0, len(codes), step):
            b = min(a + step, len(codes))
            row = self._rows(codes[a:b])
            cost = self.costs[row]
            first, last = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b, side="left")
            starts = np.maximum(at[first:last], a)
            some = np.flatnonzero(np.minimum(at[first + 1 : last + 1], b) > starts)
            out[first + some] += np.add.reduceat(cost, starts[some] - a, axis=0)
        return out


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of this partition's texts, by language."""
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                langs = batch.column("lang").dictionary_encode()
                codes, at = runs(batch.column("text"), order)
                row = np.repeat(np.asarray(langs.indices), np.diff(at))
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    code, n = np.unique(codes[row == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    return run


def learnt(labelled: DataFrame, rows: int = ROWS, order: int = ORDER) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language of ``labelled`` (doc_id, text, lang) the runs of order + 1 bytes of about ``rows`` whole texts, chosen by
    hash of the id, and how often each occurs. Texts are counted where they are; the driver gets a row for each distinct run."""
    fine = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and text != ''")
    counts = fine.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return {}
    rates = labelled.sparkSession.createDataFrame([(r[0], min(1.0, rows / r[1])) for r in counts], "name string, rate double")
    chosen = fine.join(F.broadcast(rates), F.col("lang") == F.col("name")).where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    table = chosen.select("lang", "text").mapInArrow(frugal(_counted(order)), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("code", "ascending")]).combine_chunks()
    out = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        out[lang] = (np.asarray(own["code"]), np.asarray(own["n"]))
    return out


def predicted(docs: DataFrame, training: DataFrame, rows: int = ROWS, order: int = ORDER) -> DataFrame:
    """(doc_id, lang_pred, score, bits) for each row of ``docs`` (doc_id, text), learning from ``training`` (doc_id, text, lang).

    ``lang_pred``: the language under whose tree the whole text's code is shortest, of equal ones the first by name; ``und``
    (score 0) where the text is null or has no letter, or nothing could be learnt. ``score``: 2 to the power of minus its bits
    over the sum of that for all languages. ``bits``: code length a byte, null for ``und``. Rows that repeat an id each have a
    row; no rows give no rows.
    """
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rest.withColumn("letters", F.col("text").rlike(r"\p{L}")).mapInArrow(frugal(_predictor(docs, training, rows, order, ["doc_id"]), model=True), "doc_id long, lang_pred string, score double, bits double")


def accepted(docs: DataFrame, training: DataFrame, rows: int = ROWS, order: int = ORDER) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with their columns; a null ``lang`` becomes the prediction.

    It can't be told of a text without a letter, nor of one whose shortest code is no shorter than its plain bytes (PLAIN bits
    each): no tree has learnt anything like it. Where nothing could be learnt, no row stays.
    """
    held = with_rest(docs)
    schema = T.StructType([held.schema["text"], held.schema["rest"]]).add("lang_pred", "string").add("score", "double").add("bits", "double")
    out = held.withColumn("letters", F.col("text").rlike(r"\p{L}")).mapInArrow(frugal(_predictor(docs, training, rows, order, ["text", "rest"]), model=True), schema).where((F.col("lang_pred") != UNKNOWN) & (F.col("bits") < PLAIN))
    back = as_before(out.withColumn("rest", F.col("rest").withField("lang", F.coalesce("rest.lang", "lang_pred"))) if "lang" in docs.columns else out, docs)
    return back


def _predictor(docs: DataFrame, training: DataFrame, rows: int, order: int, keep: list[str]):
    spark = docs.sparkSession
    found = learnt(training, rows, order)
    held = Held(spark, (found, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.made(lambda value: Model(*value)) if found else None
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                fine = np.asarray(batch.column("letters").fill_null(False)) & (model is not None)
                langs, score, each = np.full(len(fine), UNKNOWN, dtype=object), np.zeros(len(fine)), np.zeros(len(fine))
                if fine.any():
                    texts = batch.column("text").filter(pa.array(fine))
                    bits = model.bits(texts)
                    best = np.argmin(bits, axis=1)
                    least = bits[np.arange(len(bits)), best]
                    langs[fine] = np.array(model.langs, dtype=object)[best]
                    score[fine] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    each[fine] = least / np.maximum(1, np.asarray(pc.binary_length(texts)))
                yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(langs, pa.string()), pa.array(score), pa.array(each, mask=~fine)], [*keep, "lang_pred", "score", "bits"])

    return run
