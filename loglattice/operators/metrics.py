"""Compression ratios, loss and baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions.codec import KERNELS
from loglattice.functions.similarity import ratcliff_distance
from loglattice.operators.archive import compressed, packed_sizes


def archive_sizes(lines: DataFrame, templates: DataFrame, head_length: int, kernels: list[str]) -> DataFrame:
    """(kernel, raw_bytes, archive_bytes, ratio) of the structured archive; failed records count raw."""
    raw = lines.agg(F.sum(F.octet_length("line") + 1).alias("raw_bytes"))
    encoded, failed = compressed(lines, templates, head_length, "none")
    # both are one row
    kept = raw.crossJoin(F.broadcast(failed.agg(F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("f"))))
    out = packed_sizes(encoded, kernels).crossJoin(F.broadcast(kept)).select("kernel", "raw_bytes", (F.col("bytes") + F.col("f")).alias("archive_bytes"))
    return out.withColumn("ratio", F.round(F.col("raw_bytes") / F.col("archive_bytes"), 3))


def baselines(lines: DataFrame, by: str = "block_id") -> DataFrame:
    """(codec, raw_bytes, packed_bytes, ratio): plain codecs over each block's text; a block is bounded by its line count."""
    codecs = [k for k in KERNELS if k != "none"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        text = "\n".join(pdf.sort_values("rec_no").line).encode() + b"\n"
        return pd.DataFrame({"codec": codecs, "raw": len(text), "size": [len(KERNELS[c](text)) for c in codecs]})

    sizes = lines.groupBy(by).applyInPandas(pack, "codec string, raw long, size long")
    return sizes.groupBy("codec").agg(F.sum("raw").alias("raw_bytes"), F.sum("size").alias("packed_bytes"), F.round(F.sum("raw") / F.sum("size"), 3).alias("ratio"))


def side_by_side(lines: DataFrame, restored: DataFrame) -> DataFrame:
    """(a, b): the texts of each line by source (where lines have one) and number, null where a side lacks it."""
    keys = ["src", "rec_no"] if "src" in lines.columns else ["rec_no"]
    return lines.select(*keys, F.col("line").alias("a")).join(restored.select(*keys, F.col("line").alias("b")), keys, "full")


def match_score(lines: DataFrame, restored: DataFrame) -> DataFrame:
    """(n, score): share of lines restored exactly; lines on either side alone count as wrong."""
    both = side_by_side(lines, restored)
    return both.agg(F.count("*").alias("n"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("score"))


def ratio_score(lines: DataFrame, restored: DataFrame) -> DataFrame:
    """(n, score): mean matching-blocks ratio of the two texts of each line; lines on either side alone count 0."""
    both = side_by_side(lines, restored)
    ratio = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(1 - ratcliff_distance(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))))
    return both.agg(F.count("*").alias("n"), F.avg(ratio).alias("score"))


def reduction_rate(raw_bytes: int, archive_bytes: int) -> float:
    return 1 - archive_bytes / raw_bytes if raw_bytes else 0.0


def speed(raw_bytes: int, seconds: float) -> float:
    """Input bytes per second."""
    return raw_bytes / seconds if seconds else float("inf")
