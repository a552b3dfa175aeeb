"""The engine as one object: train, compress, restore, evaluate."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.text import head_of
from loglattice.operators import archive, headers, metrics, templates
from loglattice.operators.order import chunk_sample
from loglattice.sources import artifacts
from loglattice.sources.lines import assemble_records, read_lines


@dataclass(frozen=True)
class EngineConfig:
    """head_length: header fields before the message. kernel: lzma, gzip, bzip2, zstd or none. split: try delimiter patterns. check_header: lines whose header doesn't fit the inferred layout are kept raw."""

    head_length: int = 5
    kernel: str = "lzma"
    split: bool = True
    share: float = 0.5
    sample_rate: float = 0.1
    similarity: float = 0.1
    depth: int = 5
    width: int = 99
    least_support: int = 2
    head_regex: str | None = None
    charset: str = "utf-8"
    seed: str = "0"
    check_header: bool = False


class LogEngine:
    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()):
        self.spark, self.config = spark, config

    def read(self, path: str) -> DataFrame:
        """Lines of a file or several; records of several lines where a head_regex is set."""
        lines = read_lines(self.spark, path, self.config.charset)
        if not self.config.head_regex:
            return lines
        records = assemble_records(lines, self.config.head_regex)
        return records.select("src", "rec_no", F.floor(F.col("rec_no") / 100_000).alias("block_id"), F.col("raw").alias("line"))

    def train(self, lines: DataFrame, tree: bool = True) -> DataFrame:
        """Templates from a bounded sample of the messages, by the order-dependent tree or by signatures; rare ones are left out."""
        c = self.config
        sample = chunk_sample(lines, c.sample_rate, c.seed)
        content = sample.withColumn("line", F.substr("line", F.length(head_of(F.col("line"), c.head_length)) + 1, F.length("line"))) if c.head_length else sample
        content = content.filter(F.length(F.trim("line")) > 0)
        found = templates.trained_templates(content, c.similarity, c.depth, c.width) if tree else templates.templates_of(content)
        kept = templates.pruned(found, c.least_support)
        return self.spark.createDataFrame(kept.collect(), artifacts.TEMPLATES)

    def layout(self, lines: DataFrame) -> DataFrame:
        return headers.layout(headers.header_values(lines, self.config.head_length))

    def compress(self, lines: DataFrame, found: DataFrame, path: str) -> None:
        layout = self.layout(lines).collect() if self.config.check_header and self.config.head_length else None  # a row per part of a header field
        encoded, failed = archive.compressed(lines, found, self.config.head_length, self.config.kernel, self.config.split, layout)
        artifacts.write_archive(path, encoded, failed, found)

    def restore(self, path: str) -> DataFrame:
        return archive.restored(*artifacts.read_archive(self.spark, path))

    def evaluate(self, lines: DataFrame, path: str) -> dict:
        """Ratio of raw to archived bytes, share of lines restored exactly, and bytes per second of both ways."""
        found = self.train(lines)
        began = time.perf_counter()
        self.compress(lines, found, path)
        packed = time.perf_counter() - began
        encoded, failed, _ = artifacts.read_archive(self.spark, path)
        raw = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
        size = (encoded.agg(F.sum(F.length("payload") + F.length("meta"))).first()[0] or 0) + (failed.agg(F.sum(F.octet_length("raw") + 1)).first()[0] or 0)
        began = time.perf_counter()
        score = metrics.match_score(lines, self.restore(path)).first()
        return {"ratio": raw / size if size else 0.0, "score": score.score, "compress_speed": metrics.speed(raw, packed), "restore_speed": metrics.speed(raw, time.perf_counter() - began)}
