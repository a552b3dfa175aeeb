"""Distances, complete-linkage clusters of small samples, nearest representatives, iterative clustering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.order import hash_rank
from loglattice.sources.scratch import scratch_path, shared_dir

SAMPLE, LEAST, AHEAD = 100, 3, 32


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), squared(a, b)))


def pair_distances(vectors: DataFrame, key: str, vec: str, most: int = 2_000) -> DataFrame:
    """(a, b, dist) of all pairs of a bounded set: at most `most` vectors."""
    if vectors.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vectors; sample them first")
    a, b = vectors.select(F.col(key).alias("a"), F.col(vec).alias("x")), vectors.select(F.col(key).alias("b"), F.col(vec).alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", distance(F.col("x"), F.col("y")).alias("dist"))


def linkage_labels(points: np.ndarray, threshold: float) -> np.ndarray:
    """Complete linkage cut at a distance: the closest two clusters merge while their farthest members are within it."""
    n = len(points)
    labels = np.arange(n)
    if n < 2:
        return labels
    d = np.sqrt(np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1), 0))
    np.fill_diagonal(d, np.inf)
    while True:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        far = np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def complete_linkage(vectors: DataFrame, key: str, vec: str, threshold: float) -> DataFrame:
    """(key, cluster) of a bounded sample (at most SAMPLE rows by hash)."""
    sample = hash_rank(vectors.select(key, vec), "linkage", key, SAMPLE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        labels = linkage_labels(np.array(pdf[vec].tolist(), float).reshape(len(pdf), -1), threshold)
        return pd.DataFrame({key: pdf[key].to_numpy(), "cluster": labels.astype(np.int64)})

    return sample.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: run(pdf), f"{key} long, cluster long")


def representatives(vectors: DataFrame, cluster: str, vec: str, least: int = LEAST) -> DataFrame:
    """(cluster, center): mean vector of clusters with at least `least` members."""
    sizes = vectors.groupBy(cluster).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(cluster)
    cells = vectors.join(F.broadcast(sizes), cluster).select(cluster, F.posexplode(vec).alias("i", "x"))
    means = cells.groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("center"))


def nearest(vectors: DataFrame, centers: DataFrame, key: str, vec: str, cluster: str, threshold: float | None = None, most: int = 10_000) -> DataFrame:
    """(key, cluster, dist) of the nearest center; without those that are not below the threshold. Centers are at most `most` and come as one array."""
    if centers.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centers")
    table = centers.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("center").alias("v")))).alias("t"))
    scored = vectors.crossJoin(F.broadcast(table)).select(key, F.array_min(F.transform("t", lambda r: F.struct(distance(F.col(vec), r["v"]).alias("dist"), r["c"].alias("c")))).alias("m"))
    out = scored.select(key, F.col("m.c").alias(cluster), F.col("m.dist").alias("dist"))
    return out if threshold is None else out.filter(F.col("dist") < threshold)


def min_distance(vectors: DataFrame, chosen: DataFrame, key: str, vec: str, most: int = 10_000) -> DataFrame:
    """(key, dist): for every row the least distance to a chosen set of vectors. The set has at most `most` rows and comes as one array; an empty one gives null."""
    if chosen.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} chosen vectors")
    table = chosen.agg(F.collect_list(F.col(vec)).alias("_t"))
    return vectors.crossJoin(F.broadcast(table)).select(key, F.array_min(F.transform("_t", lambda v: distance(F.col(vec), v))).alias("dist"))


def sampled_clusters(left: DataFrame, key: str, vec: str, threshold: float, n: int, numbers: range, seed: str) -> DataFrame:
    """(round, cluster, key, vec): complete-linkage clusters of each round's sample of n rows. Samples are ranked by key alone, in a task per core."""
    keys = left.select(key).coalesce(left.sparkSession.sparkContext.defaultParallelism)
    samples = [hash_rank(keys, f"{seed}-{i}", key, n).withColumn("round", F.lit(i)) for i in numbers]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        labels = linkage_labels(np.array(pdf[vec].tolist(), float).reshape(len(pdf), -1), threshold)
        return pdf.assign(cluster=labels.astype(np.int64))[["round", "cluster", key, vec]]

    kind = left.schema[key].dataType.simpleString()
    return left.join(F.broadcast(reduce(DataFrame.union, samples)), key).groupBy("round").applyInPandas(lambda pdf: run(pdf), f"round int, cluster long, `{key}` {kind}, `{vec}` array<double>")


def iterative_clusters(vectors: DataFrame, key: str, vec: str, threshold: float, rate: float = 0.1, fruitless: int = 200, seed: str = "0") -> DataFrame:
    """(key, cluster): sample, cluster, take means, assign all that are near, repeat on the rest.

    The loop ends when more than `fruitless` rounds in a row found no cluster of
    LEAST members or assigned nothing, or when no sample can hold such a
    cluster. The rows left are the same until a round succeeds, so the samples
    of up to AHEAD rounds are looked at in one job and the first that succeeds
    counts. Per round at most SAMPLE rows meet in one task. Remaining rows have
    cluster -1.
    """
    spark = vectors.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    path = scratch_path(spark, "clusters")
    left, base, number, vain, ahead = vectors.select(key, F.col(vec).cast("array<double>").alias(vec)).checkpoint(), 0, 0, 0, 1
    n = left.count()
    while vain <= fruitless:
        size = min(max(int(n * rate), 1), SAMPLE, n)
        if size < LEAST:
            break
        numbers = range(number, number + min(ahead, fruitless + 1 - vain))
        tried = sampled_clusters(left, key, vec, threshold, size, numbers, seed).checkpoint()
        good = tried.groupBy("round", "cluster").count().filter(F.col("count") >= LEAST).agg(F.min("round")).first()[0]
        found = None
        if good is not None:
            centers = representatives(tried.filter(F.col("round") == good), "cluster", vec, LEAST).checkpoint()
            found = nearest(left, centers, key, vec, "cluster", threshold).select(key, (F.col("cluster") + base).alias("cluster")).checkpoint()
        last = numbers[-1] if good is None else good
        vain, number = vain + last + 1 - number, last + 1
        ahead = min(2 * ahead, AHEAD)
        if found is not None and not found.isEmpty():
            found.write.mode("append").parquet(path)
            left = left.join(found.select(key), key, "left_anti").checkpoint()
            n, base, vain, ahead = left.count(), base + SAMPLE, 0, 1
    rest = left.select(key, F.lit(-1).cast("long").alias("cluster"))
    return spark.read.schema(rest.schema).parquet(path).union(rest) if base else rest


def farthest_first(vectors: DataFrame, key: str, vec: str, n: int, candidates: int = SAMPLE, seed: str = "0") -> list[int]:
    """Keys chosen one by one from a bounded candidate set, each with the largest least distance to those before."""
    rows = hash_rank(vectors.select(key, vec), seed, key, candidates).collect()
    points = np.array([r[vec] for r in rows], float).reshape(len(rows), -1)
    chosen = [0] if rows else []
    while len(chosen) < min(n, len(rows)):
        d = np.sqrt(((points[:, None] - points[None, chosen]) ** 2).sum(-1)).min(1)
        chosen.append(int(np.argmax(d)))
    return [rows[i][key] for i in chosen]
