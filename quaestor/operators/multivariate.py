"""Reductions and clusterings. The cluster aggregates matrices as large as the variables or categories; numpy solves them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.exprs import col, number


def viable(df: DataFrame, candidates: list[str], min_rows: int = 10, min_vars: int = 2, numeric: bool = False) -> list[str]:
    """Variables, most values first, kept while enough rows have all of them; else the first two. One pass counts the patterns of nulls."""
    has = [(number(col(c)) if numeric else col(c)).isNotNull() for c in candidates]
    patterns = df.groupBy(F.concat(*[h.cast("int").cast("string") for h in has]).alias("p")).count().collect() if candidates else []
    count = lambda ks: sum(r["count"] for r in patterns if all(r["p"][k] == "1" for k in ks))
    order = sorted(range(len(candidates)), key=lambda k: -count([k]))
    kept: list[int] = []
    for k in order:
        if count([*kept, k]) >= min_rows:
            kept.append(k)
    kept = kept if len(kept) >= min_vars else order[:2]
    return [candidates[k] for k in kept]


def _complete(df: DataFrame, names: list[str]) -> DataFrame:
    rows = df.select([number(col(n)).alias(n) for n in names])
    return rows.na.drop()


def _moments(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, means, population deviations, correlations) from one aggregate."""
    pairs = list(combinations(range(len(names)), 2))
    found = rows.agg(F.count("*"), *[F.avg(col(n)) for n in names], *[F.stddev_pop(col(n)) for n in names], *[F.corr(col(names[i]), col(names[j])) for i, j in pairs]).first()
    n, p = found[0], len(names)
    if not n:
        raise ValueError("no complete rows")
    r = np.eye(p)
    for (i, j), x in zip(pairs, found[1 + 2 * p :], strict=True):
        r[i, j] = r[j, i] = x if x is not None and np.isfinite(x) else 0.0
    return n, np.array(found[1 : 1 + p], float), np.array(found[1 + p : 1 + 2 * p], float), r


def pca(df: DataFrame, names: list[str], k: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(eigenvalues, loadings, scores) of standardised variables, over complete rows. The sign of an axis is its largest loading's."""
    rows = _complete(df, names)
    n, mean, std, r = _moments(rows, names)
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(names))])
    share = 100 * values / values.sum()
    spark = df.sparkSession
    k = min(k, len(names))
    eigen = spark.createDataFrame([(a + 1, float(round(v * n / (n - 1), 4)), float(round(s, 2)), float(round(c, 2))) for a, (v, s, c) in enumerate(zip(values, share, share.cumsum(), strict=True))], "axis int, eigenvalue double, pct double, cum_pct double")
    loadings = spark.createDataFrame([(names[i], a + 1, float(vectors[i, a]), float(abs(vectors[i, a]))) for i in range(len(names)) for a in range(k)], "variable string, axis int, loading double, size double")
    z = [(col(x) - float(mean[i])) / float(std[i] or 1.0) for i, x in enumerate(names)]
    scores = rows.select(*[sum((z[i] * float(vectors[i, a]) for i in range(len(names))), F.lit(0.0)).alias(f"axis{a + 1}") for a in range(k)])
    return eigen, loadings, scores


def mca(df: DataFrame, names: list[str], k: int = 2, drop_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(inertia, coordinates) of categories, from the Burt table. ``drop_first`` leaves the first axis of the centred table out."""
    rows = df.na.drop(subset=names).select([col(n).cast("string").alias(n) for n in names])
    n = rows.count()
    categories: list[tuple[str, str]] = []
    counts: dict[tuple, int] = {}
    for a in names:
        for r in rows.groupBy(col(a)).count().collect():
            categories.append((a, r[0]))
            counts[(a, r[0]), (a, r[0])] = r["count"]
    for a, b in combinations(names, 2):
        for r in rows.groupBy(col(a), col(b)).count().collect():
            counts[(a, r[0]), (b, r[1])] = counts[(b, r[1]), (a, r[0])] = r["count"]
    categories.sort()
    burt = np.array([[counts.get((a, b), 0) for b in categories] for a in categories], float)
    q, mass = len(names), np.diag(burt) / (n * len(names))
    s = burt / (n * q * q * np.sqrt(np.outer(mass, mass))) - np.sqrt(np.outer(mass, mass))
    values, vectors = np.linalg.eigh(s)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if drop_first:
        values, vectors = values[1:], vectors[:, 1:]
    live = values > 1e-12
    share = 100 * values[live] / values[live].sum()
    spark = df.sparkSession
    inertia = spark.createDataFrame([(a + 1, float(round(v, 6)), float(round(p, 2))) for a, (v, p) in enumerate(zip(values[live], share, strict=True))], "axis int, inertia double, pct double")
    coords = spark.createDataFrame([(v, c, a + 1, float(vectors[i, a] * np.sqrt(values[a]))) for i, (v, c) in enumerate(categories) for a in range(min(k, int(live.sum())))], "variable string, category string, axis int, raw_coord double")
    return inertia, coords


def ca(df: DataFrame, row: str, column: str, axes: int = 4) -> tuple[DataFrame, DataFrame]:
    """(inertia, coordinates) of a contingency table; coordinates are not divided by the root of the mass."""
    found = df.na.drop(subset=[row, column]).groupBy(col(row).cast("string").alias("r"), col(column).cast("string").alias("c")).count().collect()
    rows, cols = sorted({x["r"] for x in found}), sorted({x["c"] for x in found})
    t = np.zeros((len(rows), len(cols)))
    for x in found:
        t[rows.index(x["r"]), cols.index(x["c"])] = x["count"]
    p = t / t.sum()
    e = np.outer(p.sum(1), p.sum(0))
    u, s, v = np.linalg.svd((p - e) / np.sqrt(e), full_matrices=False)
    k = min(axes, len(rows) - 1, len(cols) - 1)
    total = (s**2).sum()
    spark = df.sparkSession
    inertia = spark.createDataFrame([(a + 1, float(round(s[a] ** 2, 8)), float(round(100 * s[a] ** 2 / total, 2))) for a in range(k)], "axis int, inertia double, pct double")
    coords = [("row", x, a + 1, float(u[i, a] * s[a])) for i, x in enumerate(rows) for a in range(k)] + [("col", x, a + 1, float(v[a, i] * s[a])) for i, x in enumerate(cols) for a in range(k)]
    return inertia, spark.createDataFrame(coords, "side string, category string, axis int, raw_coord double")


def clustered(df: DataFrame, names: list[str], k: int = 3, seed: int = 42, starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cluster``, profile (cluster, n, pct, mean of each variable)) of standardised variables: the clustering of least
    inertia of ``starts``."""
    rows = _complete(df, names)
    _, mean, std, _ = _moments(rows, names)
    z = rows.select("*", *[((col(n) - float(m)) / float(s or 1.0)).alias(f"__z{i}") for i, (n, m, s) in enumerate(zip(names, mean, std, strict=True))])
    fed = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(names))], outputCol="__v").transform(z)
    fed = fed.persist()
    models = [KMeans(featuresCol="__v", predictionCol="cluster", k=k, seed=seed + i).fit(fed) for i in range(starts)]
    fed.unpersist()
    out = min(models, key=lambda m: m.summary.trainingCost).transform(fed)
    total = out.count()
    profile = out.groupBy("cluster").agg(F.count("*").alias("n"), F.round(100.0 * F.count("*") / total, 1).alias("pct"), *[F.round(F.avg(col(n)), 2).alias(n) for n in names])
    return out.drop(*[f"__z{i}" for i in range(len(names))]), profile


def silhouette(rows: DataFrame) -> float:
    """The mean simplified silhouette by Euclidean distances to cluster centres (all pairs would grow with the square of the rows)."""
    from pyspark.ml.functions import vector_to_array

    x = rows.select("cluster", vector_to_array("__v").alias("v"))
    size = len(x.first()["v"])
    centres = [(r["cluster"], [r[f"c{i}"] for i in range(size)]) for r in x.groupBy("cluster").agg(*[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(size)]).collect()]
    if len(centres) < 2:
        return 0.0
    dist = {c: F.sqrt(sum(((F.col("v")[i] - m[i]) ** 2 for i in range(size)), F.lit(0.0))) for c, m in centres}
    own, rest = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c, d in dist.items():
        others = [e for k, e in dist.items() if k != c]
        own = F.when(F.col("cluster") == c, d).otherwise(own)
        rest = F.when(F.col("cluster") == c, F.least(*others) if len(others) > 1 else others[0]).otherwise(rest)
    return x.agg(F.avg((rest - own) / F.nullif(F.greatest(own, rest), F.lit(0.0)))).first()[0] or 0.0


def elbow(df: DataFrame, names: list[str], most: int = 8, starts: int = 3) -> DataFrame:
    """(k, inertia, silhouette) for k from 2 on, each of the best of ``starts`` clusterings."""
    n = _complete(df, names).count()
    lines = []
    for k in range(2, min(most, n - 1) + 1):
        rows, _ = clustered(df, names, k, starts=starts)
        from pyspark.ml.functions import vector_to_array

        size = len(names)
        v = rows.select("cluster", vector_to_array("__v").alias("v"))
        within = v.groupBy("cluster").agg(*[(F.var_pop(F.col("v")[i]) * F.count("*")).alias(f"c{i}") for i in range(size)]).agg(F.sum(sum((F.col(f"c{i}") for i in range(size)), F.lit(0.0)))).first()[0]
        lines.append((k, round(float(within), 4), round(float(silhouette(rows)), 4)))
    return df.sparkSession.createDataFrame(lines, "k int, inertia double, silhouette double")


def minmax_profile(profile: DataFrame, names: list[str]) -> DataFrame:
    """Each variable's cluster means scaled to 0 to 1."""
    bounds = profile.agg(*[f(col(n)).alias(f"{f.__name__}__{n}") for n in names for f in (F.min, F.max)])
    return profile.join(F.broadcast(bounds)).select("cluster", *[F.round((col(n) - col(f"min__{n}")) / (col(f"max__{n}") - col(f"min__{n}") + 1e-9), 6).alias(n) for n in names])


def one_hot(df: DataFrame, name: str, values: list | None = None) -> DataFrame:
    """``df`` with a 0/1 column for each value."""
    values = values if values is not None else sorted(r[0] for r in df.select(col(name)).where(col(name).isNotNull()).distinct().collect())
    return df.select("*", *[F.coalesce((col(name) == v).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in values])
