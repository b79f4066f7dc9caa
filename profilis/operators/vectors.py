"""Vectors: parsing, means, norms, similarity, ensembles, contrastive metrics, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.functions.stats import r6

EPSILON = 1e-8


def parse_vector(text: Column) -> Column:
    """Numbers of a text like ``[1 2, 3]``; null where one is no number."""
    bare = F.trim(F.regexp_replace(text, r"[\[\],\s]+", " "))
    numbers = F.transform(F.split(bare, " "), lambda x: x.try_cast("double"))
    return F.when((bare != "") & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, epsilon: float = EPSILON) -> Column:
    n = norm(v) + epsilon
    return F.transform(v, lambda x: x.cast("double") / n)


def fitted(v: Column, dim: int) -> Column:
    """Cut or filled with zeros to dim components."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per key and component: mean and population deviation."""
    long = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))


def vector_spread(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Deviation over all components of a key's vectors."""
    sums = rows.where(F.col(vector).isNotNull()).select(key, F.size(vector).alias("d"), F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("s"), dot(F.col(vector), F.col(vector)).alias("q"))
    per = sums.groupBy(key).agg(F.sum("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return per.select(key, r6(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("d") - F.pow(F.col("s") / F.col("d"), F.lit(2))))).alias("spread"))


def centroid_similarity(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Product of each normalised vector with the mean of all normalised vectors."""
    unit = vectors.select(id_col, normalised(F.col(vector)).alias("u"))
    means = unit.select(F.posexplode("u").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))  # one vector
    return unit.join(F.broadcast(centre)).select(id_col, r6(dot(F.col("u"), F.col("c"))).alias("similarity"))


def similarity_to_centre(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Product of each vector with the mean of all, as they are."""
    means = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))  # one vector
    return rows.join(F.broadcast(centre)).select(id_col, dot(F.col(vector), F.col("c")).alias("similarity"))


def ensemble_weights(scores: dict[str, list[float]], penalty: float = 0.2, least: float = 0.01) -> dict[str, float]:
    """Weights w with sum 1 and w >= least that minimise -mean(w . scores) + penalty * sum(w^2).

    Without active bounds w = 1/n + (m - mean of m) / (2 * penalty); bounded ones are fixed in turn.
    """
    names = list(scores)
    m = np.array([np.mean(scores[k]) for k in names])
    free, w = np.ones(len(names), dtype=bool), np.full(len(names), least)
    while free.any():
        rest = 1 - least * (~free).sum()
        w[free] = rest / free.sum() + (m[free] - m[free].mean()) / (2 * penalty)
        low = free & (w < least)
        if not low.any():
            break
        free &= ~low
        w[low] = least
    return dict(zip(names, w.tolist(), strict=True))


def _scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def ensemble(parts: list[tuple[DataFrame, float]], id_col: str, vector: str) -> DataFrame:
    """Weighted sum of normalised vectors over common ids, normalised again."""
    joined, total = None, None
    for i, (df, weight) in enumerate(parts):
        one = df.select(id_col, _scaled(normalised(F.col(vector)), weight).alias(f"v{i}"))
        joined = one if joined is None else joined.join(one, id_col)
        total = F.col(f"v{i}") if total is None else F.zip_with(total, F.col(f"v{i}"), lambda x, y: x + y)
    return joined.select(id_col, normalised(total).alias("vector"))


def infonce(pairs: DataFrame, batch: str, anchor: str, positive: str, id_col: str, temperature: float = 0.07) -> DataFrame:
    """Per batch: contrastive loss, accuracy, and mean similarity. Batches are small and
    independent, so anchors meet the positives of their own batch only."""
    a = pairs.select(batch, F.col(id_col).alias("i"), normalised(F.col(anchor)).alias("a"))
    p = pairs.select(batch, F.col(id_col).alias("j"), normalised(F.col(positive)).alias("p"))
    sims = a.join(p, batch).select(batch, "i", "j", (dot(F.col("a"), F.col("p")) / temperature).alias("s"))
    w = W.partitionBy(batch, "i")
    best = F.max("s").over(w)
    log_sum = best + F.log(F.sum(F.exp(F.col("s") - best)).over(w))
    own = sims.select(batch, "i", "j", "s", best.alias("best"), log_sum.alias("all")).where("i = j")
    return own.groupBy(batch).agg(F.count("*").alias("n"), r6(F.avg(F.col("all") - F.col("s"))).alias("loss"), r6(F.avg((F.col("s") >= F.col("best")).cast("double"))).alias("accuracy"), r6(F.avg(F.col("s") * temperature)).alias("mean_similarity"))


def clusters(vectors: DataFrame, id_col: str, vector: str, k: int = 50, seed: int = 42) -> DataFrame:
    """K-means labels of normalised vectors, k at most the number of vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.where(F.col(vector).isNotNull()).select(id_col, array_to_vector(normalised(F.col(vector))).alias("features"))
    n = unit.limit(k).count()
    model = KMeans(k=max(2, n), seed=seed, maxIter=20).fit(unit)
    return model.transform(unit).select(id_col, F.col("prediction").alias("cluster"))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """Mean of token vectors where the mask is 1; the mask has one number per vector."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    n = F.greatest(F.size(kept), F.lit(1))
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    return F.transform(F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double"))), lambda x: x / n)
