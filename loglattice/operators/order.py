"""Dense positions in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 2048


def constant_list(values: list[int], index: Column) -> Column:
    """values[index]; one folded constant."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), index)


def borders_below(borders: list[int], key: Column) -> Column:
    """How many of the sorted borders are not above the key, by binary search; 0 for null."""
    if not borders:
        return F.lit(0)
    jumps = [1 << k for k in reversed(range(len(borders).bit_length()))]

    def jump(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(borders)) & (constant_list(borders, at + by - 1) <= key), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), jump)


def with_position(df: DataFrame, key: str, name: str = "pos", cells: int = CELLS) -> DataFrame:
    """Add the row's position (from 0) by an integer key without ties; nulls come first.

    Quantiles of the key cut it in cells of about equal row counts, wherever in
    the range of longs the keys lie. One count per cell (a bounded table) gives
    every cell's first position, and rows are ranked within their cell.
    """
    shares = [k / cells for k in range(1, cells)] or [0.5]
    borders = sorted(set(df.agg(F.percentile_approx(key, shares, 10 * cells)).first()[0] or []))
    cell = borders_below(borders, F.col(key))
    counts = {r.c: r.n for r in df.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect()}
    bases, total = [], 0
    for c in range(len(borders) + 1):
        bases.append(total)
        total += counts.get(c, 0)
    ranked = df.withColumn("_cell", cell).withColumn("_k", F.row_number().over(Window.partitionBy("_cell").orderBy(key)))
    return ranked.withColumn(name, constant_list(bases, F.col("_cell")) + F.col("_k") - 1).drop("_cell", "_k")


def hash_rank(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """n rows chosen by the smallest md5 of seed and key: the same rows on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def chunk_sample(lines: DataFrame, rate: float, seed: str, order: str = "rec_no", chunk: int = 20, least: int = 50, most: int = 50_000) -> DataFrame:
    """Whole chunks of consecutive lines of a source: min(max(chunks * rate, least), most) of them, in file order."""
    number = F.floor(F.col(order) / chunk)
    chunked = lines.withColumn("chunk", F.concat_ws("|", "src", number.cast("string")) if "src" in lines.columns else number)
    chunks = chunked.select("chunk").distinct()
    n = min(max(int(chunks.count() * rate), least), most)
    return chunked.join(F.broadcast(hash_rank(chunks, seed, "chunk", n)), "chunk").drop("chunk")
