"""Operators on texts against brute force, exact round trips and held-out accuracy, and on odd, repeated and empty rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD_TEXTS, words
from quaestor.llm import bpe, interpolation, kernel, langid, minmax, packing, queries, resampling
from quaestor.llm.common import fold


def test_words_of_the_kernel():
    hashes, at = kernel.word_hashes(pa.array(ODD_TEXTS, pa.string()))
    seen = {}
    for k, t in enumerate(ODD_TEXTS):
        own = words(t)
        assert at[k + 1] - at[k] == len(own)
        for w, h in zip(own, hashes[at[k] : at[k + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len({*seen.values()}) == len(seen)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(queries.vocabulary()))


def test_bpe_is_the_library(codec, tokenizer, documents):
    pick = random.Random(3)
    texts = [t or "" for t in ODD_TEXTS] + [r[0] for r in documents.select("text").limit(60).collect()]
    texts += ["".join(pick.choice("aab hé1'") for _ in range(pick.randint(1, 60))) for _ in range(300)]
    texts += ["it's IT'LL 'S", "ΑΣ Σ İ ǅ", "a" * 5000, "<|startoftext|>x<|endoftext|", " nbsp​ \x85"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


def test_every_code_point_is_the_librarys(codec, tokenizer):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or 0xE0000 <= c < 0xE0200)]
    for k in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}a !{chr(c)}! {chr(c)}{chr(c)}" for c in points[k : k + 20_000]]
        want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want


def test_bpe_forgets_and_begins_anew(codec, tokenizer, documents, monkeypatch):
    texts = [r[0] or "" for r in documents.select("text").limit(30).collect()]
    want = codec.encode(texts)
    for most in (1, 50, 700):
        monkeypatch.setattr(bpe, "MEMORY", most)
        assert [codec.encode([x])[0] for x in texts] == want


def test_pairs_are_tested_as_merging_would(codec):
    pick = np.random.default_rng(5).choice(codec.hash_tokens, (400, 2))
    fine = codec.compatible(pick[:, 0], pick[:, 1])
    for (a, b), ok in zip(pick.tolist(), fine.tolist(), strict=True):
        left, right = codec.tokens[a], codec.tokens[b]
        if left.endswith(bpe.END):
            continue
        body = left + right.removesuffix(bpe.END)
        symbols = [*body[:-1], body[-1] + bpe.END] if right.endswith(bpe.END) else [*body]
        ids = [codec.tokens.index(s) for s in symbols] if len(symbols) < 12 else None
        if ids is not None:
            assert (bpe.merge(ids, codec.ranks) == [a, b]) == ok


def test_bpe_query_on_odd_rows(odd, empty, tokenizer):
    got = bpe.digests(odd, queries.vocabulary()).collect()
    assert len(got) == odd.count() and bpe.digests(empty, queries.vocabulary()).count() == 0
    sha = {hashlib.sha256(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in ODD_TEXTS}
    assert sha <= {r["ids_sha256"] for r in got}
    assert bpe.coded(odd, queries.vocabulary()).where("n_tokens = 0").count() >= 3


def runs(places, q, total, start=0):
    """Pieces of a queue's tokens, as tuples."""
    _, *found = places.pieces(np.array([q]), np.array([start]), np.array([total]))
    return [*zip(*(x.tolist() for x in found), strict=True)]


def test_packing_of_many_sources():
    pick = random.Random(3)
    totals = [pick.randint(3000, 6000) for _ in range(150)]
    weights = [0.0] * 150
    weights[140], weights[7] = 1.0, 3.0
    for wish in (None, weights):
        places, filled, by_window = packing.Streams(*packing.plan(totals, wish, 600)), collections.defaultdict(list), collections.defaultdict(collections.Counter)
        for q, total in enumerate(totals):
            done = 0
            for start, n, window, offset in runs(places, q, total):
                assert start == done and n > 0
                done += n
                filled[window].append((offset, n))
                by_window[window][q] += n
            assert done == total
        last = max(filled)
        assert sorted(filled) == [*range(last + 1)]
        for window, own in filled.items():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at == 600 if window < last else at <= 600
        if wish:
            assert all(abs(by_window[w][140] - 150) <= 1 and by_window[w][140] + by_window[w][7] == 600 for w in range(3))
        else:
            assert all(sum(by_window[w].get(q, 0) > 0 for q in range(62, 150)) >= 80 for w in range(0, last // 2, 50))


def test_sources_beyond_the_queues_have_their_weights(spark, tokenizer):
    rows = [(k, "some plain words of a text " * 30, f"s{k % 70:03d}") for k in range(140)] + [(k, "x", f"s{k % 70:03d}") for k in range(140, 209)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.packed(df, queries.vocabulary(), window=64, weights={"s069": 1.0}).where("sequence_id = 0").collect()
    assert {r["doc_id"] % 70 for r in got} == {69} and sum(r["length"] for r in got) == 64


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing_is_whole(odd, empty, tokenizer, weights):
    got = [r.asDict() for r in packing.packed(odd, queries.vocabulary(), window=64, weights=weights).collect()]
    windows = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, pieces in windows.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 64 or k == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    total = sum(len(tokenizer.encode(r[0] or "", add_special_tokens=False).ids) + 1 for r in odd.select("text").collect())
    assert sum(r["length"] for r in got) == total
    assert packing.packed(empty, queries.vocabulary()).count() == 0


def test_pieces_are_the_librarys_ids(odd, documents, tokenizer, monkeypatch):
    rows = odd.select("doc_id", "text", "source").unionByName(documents.select("doc_id", "text", "source").limit(60).withColumn("doc_id", F.col("doc_id") + 10**6)).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r[0]: r[1] for r in rows.select("doc_id", "text").collect()}
    monkeypatch.setattr(packing, "BLOCK", 500)
    got = collections.defaultdict(list)
    for r in packing.packed(rows, queries.vocabulary()).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], bytes(r["ids"])))
    assert got.keys() == texts.keys()
    for i, pieces in got.items():
        want, at = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], 0
        for start, length, total, ids in sorted(pieces):
            assert start == at and total == len(want) and np.frombuffer(ids, "<u4").tolist() == want[at : at + length]
            at += length
        assert at == len(want)


def test_small_sources_are_spread_over_all_windows():
    totals = [3_000_000_000, 900]
    places = packing.Places(packing.schedule(totals))
    windows = np.array([w for _, n, w, _ in runs(places, 1, 900)])
    last = sum(totals) // 4096
    assert len(windows) == 900 and (np.abs(windows / last - (np.arange(900) + 0.5) / 900) < 0.01).all()
    # Wherever a reader begins, it finds the same places.
    whole = [(w, o + k) for _, n, w, o in runs(places, 0, 9_000, 10**9) for k in range(n)]
    assert whole == [(w, o + k) for a in (0, 1_234, 5_000) for _, n, w, o in runs(places, 0, {0: 1_234, 1_234: 3_766, 5_000: 4_000}[a], 10**9 + a) for k in range(n)]


def test_rounds_are_those_of_a_deficit_round_robin():
    pick = random.Random(8)
    for _ in range(40):
        shares, size = [pick.choice([0, 1, 3, 50, 997]) for _ in range(pick.randint(1, 6))], pick.choice([1, 5, 64])
        if not sum(shares):
            continue
        rounds, total = packing.Rounds(shares, size), sum(shares)
        deficit, sent = [0] * len(shares), []
        while len(sent) < 300:
            for q, share in enumerate(shares):
                deficit[q] += share
            for q in range(len(shares)):
                if 2 * deficit[q] >= total:
                    deficit[q] -= total
                    sent.append(q)
        seen = collections.Counter()
        for at, q in enumerate(sent[:300]):
            if at % size == 0:
                assert rounds.before(np.array([at // size]))[0].tolist() == [seen[k] for k in range(len(shares))]
            assert rounds.place(np.array([q]), np.array([seen[q]]))[0] == at
            seen[q] += 1


def test_schedules_use_up_all_queues():
    pick = random.Random(1)
    for _ in range(60):
        totals = [pick.choice([0, 1, 5, 100, 5000, 30_000]) for _ in range(pick.randint(1, 7))]
        weights, window = (None if pick.random() < 0.5 else [pick.choice([0, 1, 2, 10.5]) for _ in totals]), pick.choice([16, 64, 4096])
        if not sum(totals):
            continue
        places, filled = packing.Places(packing.schedule(totals, weights, window)), collections.Counter()
        for q, total in enumerate(totals):
            for _, n, w, _ in runs(places, q, total):
                filled[w] += n
        assert sum(filled.values()) == sum(totals) and all(n == window for w, n in filled.items() if w != max(filled)) and filled[max(filled)] <= window


def test_windows_keep_the_mixture():
    totals, window = [300_000, 100_000, 50_000], 4096
    places, share = packing.Places(packing.schedule(totals, None, window)), collections.defaultdict(lambda: [0, 0, 0])
    for q, total in enumerate(totals):
        for _, n, w, _ in runs(places, q, total):
            share[w][q] += n
    for w in sorted(share)[:-2]:
        assert all(abs(n - window * t / sum(totals)) < 2 for n, t in zip(share[w], totals, strict=True))


def test_scores_against_brute_force(documents):
    got = {r["doc_id"]: r for r in interpolation.scored_by_folds(documents).collect()}
    tokens = {r[0]: [*words(r[1]), "\0"] for r in documents.select("doc_id", "text").collect()}
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    count, pairs = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if part(i) != 1:
            count.update(t)
            pairs.update(zip(["\1", *t[:-1]], t, strict=True))
    n, v = sum(count.values()), len(count)
    held = [0.0, 0.0]
    for i, t in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(count[w] > 0 for w in t) and r["train_tokens"] == n and r["held_out"] == (part(i) == 1)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if part(i) == 1:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]
    # The model plainly: counts without the deleted fold give the estimates that expectation-maximisation weighs.
    kept, kept_pairs = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if part(i) not in (1, 4):
            kept.update(t)
            kept_pairs.update(zip(["\1", *t[:-1]], t, strict=True))
    begun, kept_begun = sum(part(i) != 1 for i in tokens), sum(part(i) not in (1, 4) for i in tokens)
    before = lambda c, w, n: n if w == "\1" else c[w]
    size, kept_n, kept_v = interpolation.FLOOR * interpolation.GRID + 1, sum(kept.values()), len(kept)
    tally = collections.Counter()
    for i, t in tokens.items():
        if part(i) == 4:
            for a, b in zip(["\1", *t[:-1]], t, strict=True):
                c1 = before(kept, a, kept_begun)
                grid = lambda p: size - 1 if not p else min(round(-math.log2(max(p, 2.0**-interpolation.FLOOR)) * interpolation.GRID), size - 2)
                tally[0 if not c1 else min(int(math.log2(c1)) + 1, interpolation.LEVELS - 1), grid(kept_pairs[a, b] / max(c1, 1)), grid(kept[b] / kept_n)] += 1
    weights = interpolation.learn_weights(np.array([(*k, c) for k, c in sorted(tally.items())]), kept_v)
    for i, t in tokens.items():
        want = 0.0
        for a, b in zip(["\1", *t[:-1]], t, strict=True):
            c1 = before(count, a, begun)
            w = weights[0 if not c1 else min(int(math.log2(c1)) + 1, interpolation.LEVELS - 1)]
            want += math.log10(w[0] * (pairs[a, b] / c1 if c1 else 0) + w[1] * count[b] / n + w[2] / (v + 1))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)


def test_weights_sum_to_one_and_learn():
    grid = interpolation.GRID
    tally = np.array([[5, 1 * grid, 20 * grid, 1000], [1, interpolation.FLOOR * grid, 10 * grid, 1000], [0, interpolation.FLOOR * grid, 12 * grid, 10]])
    w = interpolation.learn_weights(tally, 1000)
    assert w.sum(1) == pytest.approx(1) and w[5, 0] > 0.99 and w[1, 1] > 0.4 and w[0, 0] == 0


def test_scores_on_odd_rows(odd, empty):
    got = interpolation.scored_by_folds(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got) and interpolation.scored_by_folds(empty).count() == 0
    assert interpolation.scored(odd, F.lit(False), F.lit(False)).where("n_known = 0").count() == odd.count()


def counted(texts):
    codes, _ = langid.runs(pa.array(texts, pa.string()))
    return np.unique(codes, return_counts=True)


def plain_ppm(training, text, order=3):
    """Code length of ``text`` by dictionaries: escapes, exclusion, contexts never met passed over."""
    low = lambda t: b" " * order + bytes(_b + 32 if 65 <= _b <= 90 else _b for _b in t.encode())
    trees = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in map(low, training):
        for i in range(order, len(t)):
            for k in range(order + 1):
                trees[k][t[i - k : i]][t[i]] += 1
    bits, t = 0.0, low(text)
    for i in range(order, len(t)):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            if t[i - k : i] not in trees[k]:
                continue
            left = {b: n for b, n in trees[k][t[i - k : i]].items() if b not in out}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if t[i] in left:
                p *= left[t[i]] / total
                break
            p *= len(left) / total
            out |= left.keys()
        else:
            p /= 256 - len(out)
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_those_of_plain_matching(monkeypatch):
    training = {"a": ["abracadabra abra", "Cadabra", "é"], "b": ["lorem ipsum dolor", "lorem lorem"]}
    texts = ["abra", "cadabra LOREM", "zzz", "日本", "", "ipsum é", "a b c d " * 20]
    model = langid.Model({k: counted(v) for k, v in training.items()})
    for _ in range(2):
        got = model.bits(pa.array(texts, pa.string()))
        for r, text in enumerate(texts):
            assert got[r].tolist() == pytest.approx([plain_ppm(training[k], text) for k in "ab"])
        monkeypatch.setattr(langid, "CELLS", 10)  # a worker that forgets
        model._forget()


def test_code_lengths_are_those_of_a_distribution():
    for texts in (["abracadabra abra", "cadabra"], ["lorem ipsum dolor"]):
        tree = langid.Tree(*counted(texts))
        for k, contexts in enumerate(tree.contexts):
            for context in contexts.tolist():
                total = np.exp2(-tree.lengths((context << 8) | np.arange(256) | (0 if k == 3 else 0x01 << 8 * (k + 1)))).sum()
                assert 0.2 < total <= 1 + 1e-9


def test_many_languages_and_long_texts(spark):
    rows = [(k, f"w{k:03d} " * 20, f"l{k:03d}") for k in range(260)] + [(1000, "qqzz " * 30_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(df, df).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_language_stage_rejects_what_no_tree_knows(spark, documents):
    df = spark.createDataFrame([(1, "日本語のテキストです。これは別の言語です。" * 5, None), (2, "123 456", None)], "doc_id long, text string, lang string")
    assert langid.accepted(df, documents).count() == 0
    clean = documents.where(F.col("text").rlike(r"\p{L}"))
    assert langid.accepted(clean, documents).count() == clean.count()


def test_language_of_held_out_documents(documents):
    got = langid.predicted(documents, documents.where(fold("doc_id", 4) != 2)).where(fold("doc_id", 4) == 2).join(documents.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()


def test_language_on_odd_rows(odd, empty, documents):
    got = langid.predicted(odd, documents).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and sum(r["lang_pred"] == "und" for r in got) >= 3
    assert {r["lang_pred"] for r in langid.predicted(odd, empty).collect()} == {"und"} and langid.predicted(empty, documents).count() == 0
    kept = langid.accepted(odd, documents)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0 and kept.where("lang is null").count() == 0


def test_resampling_keeps_good_documents(documents, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = resampling.resampled(documents, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    by = {r["quality"]: r["kept"] for r in got.collect()}
    assert by[1] >= 0.95 and by[0] <= 0.7


def test_weights_against_brute_force(documents, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = {r["doc_id"]: r for r in resampling.resampled(documents, labels).collect()}
    bad = {r["doc_id"] for r in labels.collect() if r["quality"] != 1}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1} - bad
    own = {r[0]: resampling.grams(pa.array([r[1]], pa.string()))[0].tolist() for r in documents.select("doc_id", "text").collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, g in own.items():
        raw.update(g)
        if i in good:
            target.update(g)
    kinds = resampling.BUCKETS + 4
    for i, g in own.items():
        want = sum(math.log((target[b] + 1) / (sum(target.values()) + kinds) / ((raw[b] + 1) / (sum(raw.values()) + kinds))) * n for b, n in collections.Counter(g).items())
        assert got[i]["log_weight"] == pytest.approx(want, abs=1e-6) and got[i]["n_grams"] == len(g)


def test_grams_of_a_text():
    text = "abc abc x abc"
    b, row = resampling.grams(pa.array([text, None, "a"], pa.string()))
    assert len(b) == sum(len(text) - n + 1 for n in resampling.LENGTHS) + 2 and set(row.tolist()) == {0}
    same = collections.Counter(b.tolist())
    pieces = [collections.Counter(text[k : k + n] for k in range(len(text) - n + 1)) for n in resampling.LENGTHS]
    assert sorted(same.values()) == sorted([*(n for p in pieces for n in p.values()), 1, 1])


def test_exactly_k_are_drawn(documents, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = resampling.resampled(documents, labels, k=37).collect()
    assert sum(r["kept"] for r in got) == 37 and min(r["key"] for r in got if r["kept"]) >= max(r["key"] for r in got if not r["kept"])


def test_gumbel_draws_in_proportion(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(3.0)).otherwise(0.0).alias("log_weight")).withColumn("key", resampling._key(1))
    least = resampling.cut(rows, 400)
    even = rows.where((F.col("key") >= least) & (F.col("doc_id") % 2 == 0)).count()
    assert 265 <= even <= 335


def test_resampling_on_odd_rows(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert resampling.resampled(odd, none).where("kept").count() == odd.count() and resampling.resampled(empty, none).count() == 0
    some = spark.createDataFrame([(10, 1), (5, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    assert resampling.resampled(odd, some).count() == odd.count() and resampling.accepted(odd, some).columns == odd.columns


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(documents, spark):
    pick = random.Random(2)
    base = [f"w{pick.randint(0, 400)}" for _ in range(120)]
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    for k in range(60):  # copies at all distances round the threshold
        copy = [*base]
        for _ in range(k % 12):
            copy[pick.randrange(len(copy))] = f"e{pick.random()}"
        rows.append((10_000 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(df, n=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    keys = minmax.signature(np.concatenate([both, a, both, b]), np.array([0, 900, 1800]), bands=400, rows=1)
    assert (keys[0] == keys[1]).mean() == pytest.approx(0.8, abs=0.07)


def test_near_duplicates_on_odd_rows(odd, empty):
    got = minmax.near_duplicates(odd, n=4).collect()
    assert len(got) == odd.count() and all(r["component_id"] == r["doc_id"] for r in got if not r["n_shingles"])
    same = [r for r in got if r["doc_id"] in (10, 11)]
    assert {r["component_id"] for r in same} == {10} and minmax.near_duplicates(empty).count() == 0
    kept = minmax.deduplicated(odd, n=4)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 11").count() == 0


def test_sieve_loses_no_id(spark):
    from quaestor.llm.sieve import sieve

    ids = spark.range(0, 3000, 3)
    passed = {r[0] for r in spark.range(3000).where(sieve(ids)(F.col("id"))).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 1100
    assert spark.range(50).where(sieve(ids.where("false"))(F.col("id"))).count() == 0
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").where(sieve(ids)(F.col("id"))).count() == 0
