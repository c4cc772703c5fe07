"""BPE encoding by speculation: longest matches are proposed, adjacent pairs are tested, and only failing words are merged exactly.

The vocabulary file is one of the public word-level BPE files (end-of-word suffix, byte-level symbols, lower case). The file is
read on the driver; its tables, whose size the vocabulary fixes, are broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import Held, slices
from quaestor.llm.kernel import mix

END = "</w>"
NEVER = np.iinfo(np.int64).max
#: Distinct words that a worker remembers, by 64-bit hash, some 80 bytes each; when it has more, it begins anew.
MEMORY = 1 << 19

# What follows an apostrophe in the pre-tokenizer's pattern
# 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
CLITICS = "s t m d re ve ll"
# White space (\s), and letters that later Unicode versions than Python's have in two cases.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LATER_CASES = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
# Where Unicode 16 has added letters and numbers.
LATER = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
SPACE, LETTER, NUMBER, OTHER = range(4)

#: Words of more bytes are merged one by one, with a heap.
LONG = 48

_rng = np.random.default_rng(11)
SYMBOLS = _rng.integers(0, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LETTER_STEP = np.uint64(0xD6E8FEB86659FD93)


_later = re.compile("[" + "".join(map(chr, LATER_CASES)) + "]")


@cache
def kinds() -> np.ndarray:
    """Space, letter, number or other for each code point, as of Unicode 16."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    for first, last in LATER:
        for c in range(first, last + 1):
            out[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER
    out[SPACES] = SPACE
    return out


def lowered(text: str) -> str:
    """Composed and lower-cased letter by letter, whatever surrounds them."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _later.search(text):
            text = text.translate(LATER_CASES)
    return text.lower()


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a lower-cased text's pre-tokens: the first place, the length, and a 64-bit hash."""
    ends = "   "  # room for what follows a last apostrophe
    try:
        code = np.frombuffer((text + ends).encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        code = np.frombuffer((text + ends).encode("utf-32-le"), dtype=np.uint32)
    kind = kinds()[code]
    begins = np.empty(len(kind), dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == NUMBER
    begins &= kind != SPACE
    # An apostrophe that begins a run of other characters takes the letters of a clitic with it.
    for at in [np.flatnonzero((code == 0x27) & begins)]:
        for clitic in CLITICS.split():
            own = at[np.logical_and.reduce([code[at + 1 + k] == ord(c) for k, c in enumerate(clitic)])]
            begins[own + 1] = False
            own = own + 1 + len(clitic)
            begins[own[kind[own] == LETTER]] = True
    solid = np.flatnonzero(kind != SPACE)
    first = np.flatnonzero(begins[solid])
    if not len(first):
        return first, first, np.zeros(0, np.uint64)
    length = np.diff(first, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(first, length)
    h = (code[solid].astype(np.uint64) + np.uint64(1)) * LETTER_STEP
    h ^= h >> np.uint64(31)
    h *= np.cumprod(np.full(int(length.max()), BASE))[place]
    return solid[first], length, mix(np.add.reduceat(h, first) + length.astype(np.uint64))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in own else chr(free))
        free += b not in own
    return out


def load(path: str) -> dict:
    """The tables of a vocabulary file: tokens, special tokens, merges, and of each token the merge that makes it."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model.get("ignore_merges") or model.get("byte_fallback"):
        raise ValueError("only word-level BPE files with an end-of-word suffix are read")
    vocab = model["vocab"]
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    tokens = [""] * size
    for text, i in [*vocab.items(), *special.items()]:
        tokens[i] = text
    left, right, rank = (np.full(size, fill, dtype=np.int64) for fill in (-1, -1, -1))
    reached = {}
    for text, i in vocab.items():
        made: list[tuple[int, int, int]] = []
        body = text.removesuffix(END)
        symbols = [*body[:-1], body[-1:] + END] if text.endswith(END) and body else [*text]
        if all(s in vocab for s in symbols) and merge([vocab[s] for s in symbols], ranks, made) == [i]:
            reached[text] = i
            if made:
                rank[i], left[i], right[i] = made[-1]
    symbols = byte_symbols()
    byte_of = {c: b for b, c in enumerate(symbols)}
    hashes = np.zeros(len(reached), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, text in enumerate(reached):
            spelt = [byte_of[c] + 1 for c in text.removesuffix(END)] + [0] * text.endswith(END)
            hashes[k] = (SYMBOLS[spelt] * np.cumprod(np.full(len(spelt), BASE)) * INVERSE).sum()
    return {
        "tokens": tokens, "special": special, "ranks": ranks, "left": left, "right": right, "rank": rank, "longest": max(len(t) - 3 * t.endswith(END) for t in reached),
        "keys": np.array([a << 32 | b for a, b in ranks], dtype=np.int64), "key_ranks": np.array([r for r, _ in ranks.values()], dtype=np.int64), "key_made": np.array([m for _, m in ranks.values()], dtype=np.int64),
        "hashes": hashes, "hash_tokens": np.array([*reached.values()], dtype=np.int64), "base": np.array([vocab[c] for c in symbols], dtype=np.int64), "base_end": np.array([vocab[c + END] for c in symbols], dtype=np.int64),
    }


def merge(ids: list[int], ranks: dict, made: list | None = None) -> list[int]:
    """Exact merging: the pair of lowest rank first, the leftmost among equals. ``made`` gets (rank, left, right) of each merge."""
    n = len(ids)
    ids, after, before, heap = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)], []
    for k in range(n - 1):
        if found := ranks.get((ids[k], ids[k + 1])):
            heap.append((found[0], k, ids[k], ids[k + 1]))
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        j = after[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        if made is not None:
            made.append((rank, a, b))
        ids[k], ids[j], after[k] = ranks[a, b][1], -1, after[j]
        if after[j] < n:
            before[after[j]] = k
            if found := ranks.get((ids[k], ids[after[k]])):
                heapq.heappush(heap, (found[0], k, ids[k], ids[after[k]]))
        if (p := before[k]) >= 0 and (found := ranks.get((ids[p], ids[k]))):
            heapq.heappush(heap, (found[0], p, ids[p], ids[k]))
    return [x for x in ids if x >= 0]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32 | b).astype(np.uint64)


class Lookup:
    """A vectorised hash table from 64-bit keys to positions; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 6).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.at = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
        self.put(keys, np.arange(len(keys)))

    def put(self, keys: np.ndarray, at: np.ndarray) -> None:
        """Adds absent ``keys`` with their positions."""
        rest = np.arange(len(keys))
        slot = (keys * BASE >> self.shift).astype(np.int64)
        while len(rest):
            free = rest[self.at[slot[rest]] < 0]
            self.at[slot[free]] = at[free]
            mine = self.at[slot[rest]] == at[rest]
            self.keys[slot[rest[mine]]] = keys[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & (len(self.at) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys * BASE >> self.shift).astype(np.int64)
        out = self.at[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.at) - 1)
            out[wrong] = self.at[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


class Known:
    """Words that have been encoded: a hash table from 64-bit keys to runs of ids, which grows."""

    def __init__(self):
        self.keys, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.table = Lookup(self.keys)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.table.get(keys)

    def add(self, keys: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> None:
        """New ``keys``; the k-th has ``ids`` from begin[k] to begin[k + 1]."""
        old, self.keys = len(self.keys), np.append(self.keys, keys)
        self.begin, self.count = np.append(self.begin, begin[:-1] + len(self.ids)), np.append(self.count, np.diff(begin))
        self.ids = np.append(self.ids, ids.astype(np.uint32))
        if 2 * len(self.keys) > len(self.table.at):
            self.table = Lookup(self.keys)
        else:
            self.table.put(keys, np.arange(old, len(self.keys)))


class Codec:
    """Encodes and decodes; one for each worker process and vocabulary."""

    def __init__(self, tables: dict):
        self.__dict__.update(tables)
        self.pairs = Lookup(self.keys.astype(np.uint64))
        self.by_hash = Lookup(self.hashes)
        self.known = Known()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # Words

    def propose(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by greedy longest match, and the word of each; a word's symbols are its bytes + 1, then 0."""
        powers = np.cumprod(np.full(len(data) + 1, BASE)) * INVERSE
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(SYMBOLS[data] * powers[:-1], out=sums[1:])
        back = np.cumprod(np.full(len(data) + 1, INVERSE)) * BASE
        at, who, end = begin[:-1].copy(), np.arange(len(begin) - 1), begin[1:]
        places, tokens = [], []
        while len(at):
            found = np.full(len(at), -1, dtype=np.int64)
            length = np.zeros(len(at), dtype=np.int64)
            left = end[who] - at
            open_ = np.arange(len(at))
            for n in range(int(min(self.longest, left.max())), 0, -1):
                # A token covers the last byte only together with the end of the word.
                try_ = open_[(left[open_] >= n) & (left[open_] != n + 1)]
                got = self.by_hash.get((sums[at[try_] + n] - sums[at[try_]]) * back[at[try_]])
                hit = got >= 0
                found[try_[hit]], length[try_[hit]] = self.hash_tokens[got[hit]], n
                open_ = open_[found[open_] < 0]
                if not len(open_):
                    break
            if len(open_):
                raise ValueError("the vocabulary lacks a byte")
            places.append(at)
            tokens.append(found)
            at = at + length
            go = at < end[who]
            at, who = at[go], who[go]
        places, tokens = np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(places, kind="stable")
        return tokens[order], np.searchsorted(begin, places[order], side="right") - 1

    def merged(self, ids: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each step, each word's leftmost pair of lowest rank becomes one token."""
        done = []
        while len(ids):
            at = self.pairs.get(pair_keys(ids[:-1], ids[1:]))
            rank = np.append(np.where((at >= 0) & (who[:-1] == who[1:]), self.key_ranks[at], NEVER), NEVER)
            begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(begin, append=len(ids)))
            over = least == NEVER
            done.append((ids[over], who[over]))
            first = np.flatnonzero((rank == least) & ~over)
            first = first[np.append(True, who[first][1:] != who[first][:-1])] if len(first) else first
            keep = ~over
            ids[first] = self.key_made[at[first]]
            keep[first + 1] = False
            ids, who = ids[keep], who[keep]
        ids, who = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(who, kind="stable")
        return ids[order], who[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave token a before token b as they are.

        The merges that made a and b are undone, latest first; while x ends a and y begins b, a merge of x and y must not come
        before the one that takes x or y up. Of equal ranks the left one comes first.
        """
        good = np.ones(len(a), dtype=bool)
        x, y, who = a.copy(), b.copy(), np.arange(len(a))
        px, py = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(who):
            at = self.pairs.get(pair_keys(x, y))
            m = np.where(at >= 0, self.key_ranks[at], NEVER)
            bad = (m < px) & (m <= py)
            good[who[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            x, y, px, py, rx, ry, who = (v[go] for v in (x, y, px, py, rx, ry, who))
            by_x = rx > ry
            px, py = np.where(by_x, rx, px), np.where(by_x, py, ry)
            x, y = np.where(by_x, self.right[x], x), np.where(by_x, y, self.left[y])
        return good

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, and where each word's begin: proposes, tests all adjacent pairs at once, merges those words exactly that fail."""
        spelt = [x.encode("utf-8") for x in words]
        data = np.frombuffer(b"\0".join(spelt) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        begin = np.cumsum([0, *(len(x) + 1 for x in spelt)])
        data[begin[1:] - 1] = 0
        tokens, who = self.propose(data, begin)
        inner = np.flatnonzero(who[1:] == who[:-1])
        pairs, back = np.unique(tokens[inner] << 32 | tokens[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(who[inner[~fine]])
        if len(failing):
            length = np.diff(begin)[failing] - 1
            long = failing[length > LONG]
            short = failing[length <= LONG]
            parts = [self._long(self.base[data[begin[k] : begin[k + 1] - 1] - 1], k) for k in long]
            if len(short):
                count = np.diff(begin)[short] - 1
                last = np.cumsum(count) - 1
                where = np.arange(last[-1] + 1) + np.repeat(begin[short] - np.append(0, last[:-1] + 1), count)
                ids = self.base[data[where] - 1]
                ids[last] = self.base_end[data[where[last]] - 1]
                parts.append(self.merged(ids, np.repeat(short, count)))
            keep = ~np.isin(who, failing)
            tokens, who = (np.concatenate(x) for x in zip((tokens[keep], who[keep]), *parts, strict=True))
            order = np.argsort(who, kind="stable")
            tokens, who = tokens[order], who[order]
        return tokens, np.searchsorted(who, np.arange(len(words) + 1))

    def _long(self, symbols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        out = merge([*symbols[:-1].tolist(), int(self.base_end[np.flatnonzero(self.base == symbols[-1])[0]])], self.ranks)
        return np.array(out, dtype=np.int64), np.full(len(out), k)

    # Texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Words are told apart by 64-bit hashes."""
        # Special tokens are found in the text as it is; what lies between them is a text of its own.
        parts = [[text] if self.split is None or not self.split.search(text) else self.split.split(text) for text in texts]
        plain = [lowered(x) for own in parts for x in own[::2]]
        whole = "\n".join(plain)
        at, length, hashes = spans(whole)
        row = self.known.find(hashes)
        if len(new := np.flatnonzero(row < 0)):
            fresh, one = np.unique(hashes[new], return_index=True)
            one = new[one]
            if len(self.known) + len(fresh) > MEMORY:
                # All words of this batch are learnt again, so that none points into what was forgotten.
                self.known = Known()
                fresh, one = np.unique(hashes, return_index=True)
            ids, begin = self.learn([whole[a : a + n] for a, n in zip(at[one].tolist(), length[one].tolist(), strict=True)])
            self.known.add(fresh, ids, begin)
            row = self.known.find(hashes)
        begin, count = self.known.begin[row], self.known.count[row]
        ends = np.cumsum(count)
        ids = self.known.ids[np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        starts = np.cumsum([0, *(len(x) + 1 for x in plain)])[:-1]
        edges = (4 * np.append(0, ends)[np.append(np.searchsorted(at, starts), len(at))]).tolist()
        coded = iter([ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
        return [next(coded) if len(own) == 1 else b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if k % 2 else next(coded) for k, x in enumerate(own)) for own in parts]

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: tokens are joined by single spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(held: Held) -> Codec:
    """This process's codec for a broadcast of ``load``'s tables."""
    return held.made(Codec)


def coded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``ids``: little-endian unsigned 32-bit integers; ``decoded``: the text that decoding them gives. A null text counts as
    empty and gives no ids and an empty text; rows that repeat an id each have a row. No rows give no rows.
    """
    held = Held(docs.sparkSession, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = own.encode([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``coded``, without sending ids and texts back to the JVM."""
    held = Held(docs.sparkSession, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = own.encode([x or "" for x in batch.column("text").to_pylist()])
                hexes = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in ids]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, hexes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
