"""Tumbling windows of template ids, their weighted vectors, and samples of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_windows(ids: DataFrame, h: int) -> DataFrame:
    """(win_id, seq): h consecutive ids by pos; the last window is padded with -1 and no empty one is made."""
    grouped = ids.groupBy(F.floor(F.col("pos") / h).alias("win_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "eid"))).alias("s"))
    seq = F.transform("s", lambda x: x["eid"].cast("int"))
    return grouped.select("win_id", F.slice(F.concat(seq, F.array_repeat(F.lit(-1), h)), 1, h).alias("seq"))


def window_hist(ids: DataFrame, h: int) -> DataFrame:
    """(win_id, eid, n)."""
    return ids.groupBy(F.floor(F.col("pos") / h).alias("win_id"), "eid").agg(F.count("*").alias("n"))


def idf_weights(hist: DataFrame) -> DataFrame:
    """(eid, weight): ln((N+1)/(df+1)) less its mean, through a sigmoid."""
    n = hist.agg(F.count_distinct("win_id").alias("N"))
    x = hist.groupBy("eid").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("eid", F.log((F.col("N") + 1) / (F.col("df") + F.lit(1.0))).alias("x"))
    mean = x.agg(F.avg("x").alias("m"))
    return x.crossJoin(F.broadcast(mean)).select("eid", (1 / (1 + F.exp(F.col("m") - F.col("x")))).alias("weight"))


def window_vectors(hist: DataFrame) -> DataFrame:
    """(win_id, eid, w): counts times weights, sparse."""
    return hist.join(idf_weights(hist), "eid").select("win_id", "eid", (F.col("n") * F.col("weight")).alias("w"))


def window_rows(ids: DataFrame, chosen: DataFrame, h: int) -> DataFrame:
    """The rows of chosen windows (win_id)."""
    return ids.withColumn("win_id", F.floor(F.col("pos") / h)).join(chosen.select("win_id"), "win_id", "left_semi").drop("win_id")


def balanced_sample(labelled: DataFrame, per_cluster: int, seed: str, key: str = "win_id", cluster: str = "cluster") -> DataFrame:
    """Up to per_cluster windows of every cluster, by hash rank without replacement."""
    w = Window.partitionBy(cluster).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return labelled.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_cluster).drop("_k")


def center_index(labelled: DataFrame, key: str = "win_id", cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(cluster).agg(F.min(key).alias("center"))
