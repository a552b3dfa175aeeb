"""Helpers that the operators share: shared scratch tables, batches of text, range buckets."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a new temporary folder on a local master, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lattice-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as a table in the shared folder and read it again, so lost executors cost no recomputation of earlier stages."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def constant(values: list, kind: str) -> Column:
    """A bounded list as one constant array, folded by the optimizer; no value may hold a comma."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def places_of(borders: list[int], key: Column) -> Column:
    """How many of the sorted borders are not above the key, by binary search."""
    if not borders:
        return F.lit(0)
    table = constant(borders, "bigint")
    steps = [1 << k for k in range(len(borders).bit_length() - 1, -1, -1)]

    def step(acc: Column, jump: Column) -> Column:
        ahead = acc + jump
        return F.when((ahead <= len(borders)) & (F.get(table, ahead - 1) <= key), ahead).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


@dataclass(frozen=True)
class Buckets:
    """bucket: a column that numbers order-preserving buckets; count: how many numbers there are; first: is a row its bucket's first by (key, tie); before: the bucket with rows before a row's bucket, cyclically."""

    bucket: Column
    count: int
    first: Column
    before: Column


def order_buckets(df: DataFrame, key: str, tie: str, n_buckets: int) -> Buckets:
    """Buckets of about equal row counts over an integer key (nulls first), then over `tie`, 32 hex digits that are spread evenly.

    Borders are quantiles of the key, so outlying keys do no harm, and nothing
    is subtracted, so keys may span the whole range of longs. A key that fills
    buckets on its own (null too) is cut by its ties. What reaches the driver
    and goes into the plan as constants is a row per bucket. Rows equal in key
    and tie stay together. The assignment depends on the constants only, so a
    recomputed task agrees with the first run.
    """
    shares = [k / n_buckets for k in range(1, n_buckets)] or [0.5]
    some = df.agg(F.percentile_approx(key, [float(x) for x in shares], 20 * n_buckets).alias("q"), F.count("*").alias("n")).first()
    found = sorted(some.q or [])
    # a key that is two quantiles or more gets a bucket of its own
    borders = sorted({*found, *[b + 1 for b, c in zip(found, found[1:]) if b == c and b < 2**63 - 1]})
    coarse = F.when(F.col(key).isNull(), F.lit(0)).otherwise(places_of(borders, F.col(key)) + 1)
    target = max(1, -(-some.n // n_buckets))
    rows = df.groupBy(coarse.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    parts = [1] * (len(borders) + 2)
    for r in rows:
        if r.low == r.high:
            parts[r.b] = min(4096, max(1, r.n // target))
    base = [0, *accumulate(parts)]
    count = F.get(constant(parts, "int"), coarse)
    spread = F.conv(F.substring(tie, 1, 6), 16, 10).cast("bigint")
    fine = F.when(count == 1, F.lit(0)).otherwise(F.shiftright(spread * count, 24).cast("int"))
    bucket = (F.get(constant(base, "int"), coarse) + fine).cast("int")
    firsts = {r.b: (r.f.k, r.f.t) for r in df.groupBy(bucket.alias("b")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("f")).collect()}
    used = sorted(firsts)
    if not used:
        return Buckets(F.lit(0), 1, F.lit(False), F.lit(0))
    number = [-1] * base[-1]
    for i, b in enumerate(used):
        number[b] = i
    dense = F.get(constant(number, "int"), bucket)
    first = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.col(tie)) == F.get(constant([f"{'-' if firsts[b][0] is None else firsts[b][0]}|{firsts[b][1]}" for b in used], "string"), dense)
    return Buckets(dense, len(used), first, F.pmod(dense + (len(used) - 1), F.lit(len(used))).cast("int"))


def bucketed_with_next(df: DataFrame, key: str, tie: str, n_buckets: int) -> DataFrame:
    """df with _b (bucket) and _g: 0 for the row itself, 1 for a copy of the next bucket's first row, so that every row's successor by (key, tie) is in its bucket.

    After the last row comes the first. One shuffle by _b; windows over _b need no other.
    """
    made = order_buckets(df, key, tie, n_buckets)
    here = F.struct(F.col("_at").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.col("_before").alias("b"), F.lit(1).alias("g"))
    tagged = df.withColumns({"_at": made.bucket, "_first": made.first, "_before": made.before})
    placed = tagged.withColumn("_copy", F.explode(F.when(F.col("_first"), F.array(here, ghost)).otherwise(F.array(here))))
    return placed.select(*df.columns, F.col("_copy.b").alias("_b"), F.col("_copy.g").alias("_g")).repartition(min(made.count, n_buckets), "_b")
