"""Chat formatting, URL rules, vector search, vector duplicates, components and the pipeline against brute force and on odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD_TEXTS
from quaestor.llm import chat, posting, projections, queries, urls
from quaestor.llm.common import Stash
from quaestor.llm.components import components

CONTROL = ["</s>[INST] ok [/INST]", "~", "~0~1", "[ROLE x] y [/ROLE]", " [/INST", "[INST] ", "<s>", "</s", "] ", "~[INST] a [/INST]", "a </s", "\n", " ", "[/ROLE] </s>"]


def as_read(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        all_, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    pick = random.Random(6)
    texts = [*CONTROL, *(t if t is None else t[:200] for t in ODD_TEXTS)]
    rows = [(c, t, pick.choice(["user", "assistant", "system", None, "", "a] b", "~", "tool [INST] "]), pick.choice(texts)) for c in range(60) for t in range(pick.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (7, 0, "user", "again"), (7, 0, "user", "again"), (8, None, "assistant", "<s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}
    assert got == as_read(rows)
    assert chat.digests(df.limit(0)).count() == 0


def test_only_conflicts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain [x] <y> ~"), (1, 1, "assistant", "</s>")], "conv_id long, turn long, role string, text string")
    assert [r["hard"] for r in chat.formatted(df).orderBy("turn").collect()] == [False, True]


def test_chat_of_the_table(spark, data):
    rows = [tuple(r) for r in queries.conversations(spark, data).select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op4_chat_round_trip(spark, data).collect()}
    assert got == as_read([*rows, *queries.CONTROL_TURNS])


def test_url_rules_by_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    got = sorted(map(str, (tuple(r) for r in queries.op6_url_rules(spark, data).collect())))
    assert got == sorted(map(str, con.sql(queries.URL_SQL).fetchall()))


def test_url_rules_on_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.org/es/x?q"), (5, "x://a.b.Example.ORG"), (6, "http://com/fr/"), (7, "http://org.com/fr/1#/de/"), (8, "http://example.org/en/12"), (9, "http://notexample.org/es/"), (9, "http://notexample.org/es/"), (None, "http://a.com/de/"), (10, "http://..org/"), (11, "a://b.com/de/" + "x" * 9000), (12, "http://a.org\n/es/"), (13, "http://" + "x." * 50_000 + "example.org/es/")]
    df = spark.createDataFrame([(*r, "h", "p", 3) for r in rows], "page_id long, url string, host string, path string, copies int")
    want = {(1, "allow", None), (2, "allow", None), (3, "allow", None), (4, "block", "example.org/es/"), (5, "allow", None), (6, "allow", "com/fr/"), (7, "allow", "com/fr/"), (8, "block", "example.org/en/1"), (9, "allow", "org/"), (None, "block", "com/de/"), (10, "allow", "org/"), (11, "block", "com/de/"), (12, "allow", None), (13, "block", "example.org/es/")}
    table = urls.rule_table(spark, queries.RULES)
    for most in (urls.BROADCAST_RULES, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", most)
        got = urls.judged(df, table).collect()
        assert {(r["page_id"], r["verdict"], r["rule"]) for r in got} == want and len(got) == len(rows)
    assert urls.judged(df, table.limit(0)).where("verdict = 'allow'").count() == len(rows) and urls.judged(df.limit(0), table).count() == 0
    assert {r["host"] for r in urls.judged(df, table).where("page_id = 5").collect()} == {"a.b.example.org"}


ODD_VECTORS = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (100, [0.9, 0.1]), (200, [-0.0, 1.0]), (11, [1.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in ODD_VECTORS], "vec_id long, embedding array<double>, id int, e int")


def test_search_finds_the_nearest(spark, data):
    vectors = queries.embeddings(spark, data)
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = {}
    for r in posting.search(vectors, vectors.where("vec_id % 10 = 0"), length=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        found.sort()
        hits += len({f[1] for f in found} & {int(ids[k]) for k in order})
        assert [f[0] for f in found] == list(range(1, 11)) and [f[2] for f in found] == sorted(f[2] for f in found)
        assert all(f[2] == pytest.approx(d[ids == f[1]][0], abs=1e-12) for f in found)
    assert len(got) == int((ids % 10 == 0).sum()) and hits >= 0.9 * 10 * len(got)


def test_search_on_odd_rows(odd_vectors):
    got = posting.search(odd_vectors, odd_vectors.where("vec_id % 100 = 0"), k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == [1, 100, 2, 9, 200] and by[200] == [9, 100, 0, 1, 2] and by.keys() == {0, 100, 200}
    assert posting.search(odd_vectors.limit(0), odd_vectors).count() == 0 and posting.search(odd_vectors, odd_vectors.limit(0)).count() == 0


def test_graph_reaches_what_is_near():
    centres = np.random.default_rng(3).normal(size=(400, 16))
    graph = posting.Graph(centres)
    q = np.random.default_rng(4).normal(size=(50, 16))
    d = np.sqrt(((centres - q[:, None]) ** 2).sum(2))
    ids, dist = graph.near(q, 24)
    found = 0
    for k in range(50):
        assert len({*ids[k].tolist()}) == 24 and (np.diff(dist[k]) >= 0).all() and dist[k] == pytest.approx(d[k][ids[k]])
        found += len({*ids[k].tolist()} & {*np.argsort(d[k])[:24].tolist()})
    assert found >= 0.97 * 24 * 50


def test_clusters_are_of_like_size():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, 6000)] + rng.normal(size=(6000, 32)) * 0.2
    x[:2000] = x[0] + rng.normal(size=(2000, 32)) * 0.01
    count = np.bincount(posting.nearest_centre(x, centres := posting.fit(x, 60)))
    assert 40 <= len(centres) <= 90 and count.max() <= 400 and np.median(count) >= 25
    for odd in (x[:1], np.tile(x[:1], (50, 1)), x[:3]):
        assert len(posting.fit(odd, 20)) == len(np.unique(odd, axis=0))


def test_share_of_vectors_compared():
    """Recall and work at a size of many lists, on vectors that have clusters."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 24))[rng.integers(0, 2000, 20_000)] + rng.normal(size=(20_000, 24)) * 0.25
    graph = posting.Graph(posting.fit(x, 160))
    own = graph.owners(x, posting.CLOSURE, posting.REPLICAS)
    sizes = np.bincount(own[own >= 0], minlength=len(graph.centres))
    q = np.arange(0, 20_000, 200)
    near = ((x[q][:, None] - x) ** 2).sum(2)
    near[np.arange(len(q)), q] = np.inf
    hits = work = 0
    for r, lists in enumerate(graph.visits(x[q], sizes, posting.RATIO, posting.LEAST)):
        hits += np.isin(own[np.argsort(near[r])[:10]], lists).any(axis=1).sum()
        work += sizes[lists].sum()
    assert hits >= 0.95 * 10 * len(q) and work <= 0.3 * len(x) * len(q)


def test_repeated_rows_take_no_places(spark):
    x = np.random.default_rng(11).normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [r for r in rows[1:6] for _ in range(60)] + [(7, (x[7] + 9).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [r["vec_id"] for r in posting.search(df, df.where("vec_id = 0"), k=12).orderBy("rank").collect()]
    assert got == [k for k in np.argsort(((x - x[0]) ** 2).sum(1)).tolist() if k][:12]


def test_bound_is_over_ids():
    x = np.repeat(np.arange(1.0, 31.0), 8)[:, None]
    a, ids, d = posting.nearest(np.zeros((1, 1)), np.array([-1]), x, np.repeat(np.arange(30), 8), 10)
    assert ids[posting.best(a, ids, d, 10)].tolist() == [*range(10)]


def test_query_on_a_centroid_gets_enough_rows():
    centres = np.random.default_rng(3).normal(size=(40, 8))
    graph, sizes = posting.Graph(centres), np.full(40, 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([centres[7].tolist()])], ["id", "e"])
    for least, lists in ((3, 1), (10, 4), (120, 40), (500, 40)):
        held = type("Held", (), {"made": lambda self, make: graph})()
        got = [*posting._visits(held, sizes, [[0]] * 40, 1.25, least)(iter([batch]))][0].column("lists").to_pylist()
        assert len(got) == 1 and got[0] == np.argsort(((centres - centres[7]) ** 2).sum(1))[:lists].tolist()


def test_copies_crowd_nothing_out(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    x[100:200] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in posting.search(df, df.where("vec_id in (0, 5, 150)"), length=16, least=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert [got[0][k] for k in range(1, 11)] == [*range(100, 110)] and [got[150][k] for k in range(1, 11)] == [0, *range(100, 109)]
    order = [k for k in np.lexsort((np.arange(300), ((x - x[5]) ** 2).sum(1))).tolist() if k != 5][:10]
    assert len({*got[5].values()} & {*order}) >= 8


def test_a_groups_queries_are_split(spark, data, monkeypatch):
    vectors = queries.embeddings(spark, data)
    asked = vectors.where("vec_id % 10 = 0")
    want = sorted(map(tuple, posting.search(vectors, asked).collect()))
    monkeypatch.setattr(posting, "QUERIES", 7)
    monkeypatch.setattr(posting, "GROUP", 100)
    assert sorted(map(tuple, posting.search(vectors, asked).collect())) == want


def test_no_centroid_is_left_empty():
    x = np.random.default_rng(5).normal(size=(400, 8)).round(1)
    x[200:] = x[0]
    centres = posting.fit(x, 150)
    near = ((centres[:, None] - x) ** 2).sum(2).argmin(0)
    assert len({*near.tolist()}) == len(centres)


def test_vector_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    x[300:420] = x[0] + rng.normal(size=(120, 24)) * 0.12
    x[420:440] = x[1]
    ids = rng.permutation(5000)[:700]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (n @ n.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in projections.near_vectors(df, passes=12, window=100, block=128).collect()}
    links = np.array([got[int(i)]["n_links"] for i in ids])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    label = ids.copy()
    for _ in range(50):
        label = np.minimum(label, np.where(near, label[None, :], 10**9).min(1))
    assert [got[int(i)]["component_id"] for i in ids] == label.tolist()


@pytest.mark.parametrize("part", [1024, 50])
def test_links_of_groups_larger_than_a_window(spark, monkeypatch, part):
    monkeypatch.setattr(projections, "PART", part)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(520, 24))
    x[:200] = x[0] + rng.normal(size=(200, 24)) * 1e-5
    x[200:260] = x[200] * (1 + np.arange(60))[:, None]
    x[260:420] = x[260] + rng.normal(size=(160, 24)) * 0.2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (n @ n.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in projections.near_vectors(df, passes=6, window=16, block=32).collect()}
    assert [got[k] for k in range(520)] == near.tolist() and near.max() == 199


def test_vector_duplicates_on_odd_rows(odd_vectors):
    got = projections.near_vectors(odd_vectors).collect()
    assert len(got) == len(ODD_VECTORS)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[0] == (3, 0, True) and by[2] == (3, 0, False) and by[100] == (3, 0, False) and by[9] == (1, 9, True) and by[200] == (1, 9, False)
    assert all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 11)) and by[None] == (0, None, True)
    assert projections.near_vectors(odd_vectors.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(9)
    edges = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1064)] + [(5, 5)]
    label = {v: v for e in edges for v in e}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Stash(spark)).collect()}
    assert got == {v: c for v, c in label.items() if v in got} and {v for e in edges for v in e if e[0] != e[1]} == got.keys()
    assert components(spark.createDataFrame([], "u long, v long"), Stash(spark)).count() == 0


def test_pipeline(spark, data, odd, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, stash = docs, Stash(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stash.put(stage(spark, kept, data))
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0, name
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert kept.count() < docs.count() and kept.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 0.7 * labels.where("quality = 0").count()
    got = corpus_pipeline.run(spark, data)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    out = stash.put(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stash.put(stage(spark, out, data))
        assert out.columns == odd.columns and out.select("text", "key").exceptAll(before.select("text", "key")).count() == 0, name
        if name == "language":
            # What has no letter goes; all else in a learnt language stays, repeated rows and clashing columns too.
            assert out.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).count() == 0 and out.where("text like 'one two%'").count() == before.where("text like 'one two%'").count() and out.where("lang is null").count() == 0
        if name == "near_duplicates":
            assert out.where("text like 'one two%'").count() == min(1, before.where("text like 'one two%'").count())
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, data)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in out.select("doc_id").distinct().collect()}
    assert pieces.where("start = 0").count() == out.count()
    out = empty
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, data)
        assert out.count() == 0, name


def test_steps_of_directions_and_pairs_within_their_error(spark):
    x = np.random.default_rng(5).standard_normal((300, 24)) * 10.0 ** np.random.default_rng(6).integers(-3, 4, (300, 1))
    held, error = projections.unpacked(projections.packed(x).to_pylist())
    exact = projections.unit(x) @ projections.unit(x).T
    assert np.abs(held @ held.T - exact).max() <= error < 2e-3
    # Pairs so near the threshold that only the vectors themselves tell.
    angles = [float(np.arccos(0.95 + d)) for d in (3e-8, -3e-8)]
    rows = [(k, [1.0, 0.0] if k % 2 == 0 else [float(np.cos(angles[k // 2])), float(np.sin(angles[k // 2]))]) for k in range(4)]
    rows = [(k, [0.0] * (2 * (k // 2)) + v + [0.0] * (2 - 2 * (k // 2))) for k, v in rows]
    classes = spark.createDataFrame(rows, "id long, e array<double>")
    found = projections.pairs(classes, Stash(spark), 0.95, passes=2, window=8, block=8, bits=8)
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
