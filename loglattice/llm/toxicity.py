"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct 3-, 4- and 5-grams of a text's code points (A-Z
lower-cased), hashed to 2**18 slots, over the whole text. Training takes a
bounded sample of labelled rows (`max_rows`, those of smallest hash of
doc_id); for each slot the log ratio of its smoothed shares in toxic and clean
texts scales the feature, slots whose ratio is small or that few texts have are
left out, and a logistic regression with L2 penalty is fitted to the scaled
presences. What leaves the driver is a table of 2**18 floats, whatever the
size of the corpus.

Cases: null and empty texts have no features and get the intercept's score;
without usable labels of both classes the score is the smoothed share of label
1. Several label rows of a doc_id count once, as toxic if any is; null labels
and null doc_ids are not learned from. Rows are kept one to one, repeated rows
included; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.llm.common import written
from loglattice.llm.flat import Lean, chunks, flat

BITS, SIZES = 18, (3, 4, 5)
MAX_ROWS = 8_000
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per code point (its lower-cased UTF-8 bytes), and the texts' offsets in them."""
    data = LOWER[data]
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    value = data[at].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    wide = value >= 0xC0
    for k in (1, 2, 3):
        byte = padded[at[wide] + k]
        value[wide] = (value[wide] << np.uint32(8)) | np.where((byte & 0xC0) == 0x80, byte, 0).astype(np.uint32)
        if k == 1 and not wide.any():
            break
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    return value, count[offsets]


def presences(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs in order; with `known`, only slots that it marks."""
    value, ends = characters(data, offsets)
    symbols = value.astype(np.uint64) + np.uint64(1)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    limit = ends[1:][text_of] if len(text_of) else np.zeros(0, np.int64)
    keys = []
    rolling = np.zeros(len(symbols), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(SIZES)):
            rolling = rolling * STEP
            if k:
                rolling[:-k] += symbols[k:]
            else:
                rolling += symbols
            if k + 1 in SIZES:
                slot = ((rolling * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
                ok = np.arange(len(symbols)) + k < limit
                if known is not None:
                    ok &= known[slot]
                keys.append((text_of[ok] << BITS) | slot[ok])
    pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def ratios(in_toxic: np.ndarray, in_clean: np.ndarray, positives: int, n: int, least_df: int, least_ratio: float) -> np.ndarray:
    """Log ratio of each slot's smoothed shares in toxic and clean texts; 0 for slots that are left out."""
    ratio = np.log((in_toxic + 1) / (positives + 2)) - np.log((in_clean + 1) / (n - positives + 2))
    return np.where((in_toxic + in_clean >= least_df) & (np.abs(ratio) >= least_ratio), ratio, 0.0)


def fit(slots: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, penalty: float = 0.05, rounds: int = 300, positive_weight: float = 6.0) -> Model:
    """Logistic regression on presences scaled by the ratios, by gradient steps with momentum."""
    n, positives = len(toxic), int(toxic.sum())
    used = ratio != 0
    number = np.cumsum(used) - 1
    of = np.repeat(np.arange(n), [len(s) for s in slots])
    column = number[np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int64)]
    scale = ratio[used]
    x, m = scale[column], len(scale)
    weight = np.where(toxic == 1, positive_weight, 1.0)
    w, velocity, b, b_velocity = np.zeros(m), np.zeros(m), float(np.log(positives / (n - positives))), 0.0
    rate = 2.0 / max(np.bincount(of, x * x, n).mean(), 1.0)
    for _ in range(rounds):
        z = np.bincount(of, x * w[column], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * weight
        gradient = np.bincount(column, x * error[of], m) / n + penalty * w / n
        velocity = 0.9 * velocity - rate * gradient
        b_velocity = 0.9 * b_velocity - 0.5 * error.mean()
        w, b = w + velocity, b + b_velocity
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = w * scale
    return Model(weights, b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            of, slot = presences(*flat(part.column("text")))
            ends = np.searchsorted(of, np.arange(part.num_rows + 1))
            slot = slot.astype("<u4")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([slot[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "toxic", "slots"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per slot and label, summed within a task."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for toxic, blob in zip(batch.column("toxic").to_pylist(), batch.column("slots")):
            counts[1 if toxic else 0][np.frombuffer(blob.as_buffer(), "<u4")] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], names=["slot", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, least_df: int = 4, least_ratio: float = 1.0) -> Model:
    """Learn from at most max_rows labelled rows that aren't held out.

    Their features are counted on the executors; the driver gets a row per slot
    and, for each text, only the slots that the counts have left.
    """
    per_doc = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = per_doc.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = written(texts.mapInArrow(Lean(_features), "doc_id long, toxic int, slots binary"), "labelled")
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    empty = np.zeros(1 << BITS)
    if positives in (0, n):
        share = (positives + 1) / (n + 2)
        return Model(empty.astype(np.float32), float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(Lean(_counted), "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    in_toxic, in_clean = empty.copy(), empty.copy()
    slot = counts["slot"].to_numpy()
    in_toxic[slot], in_clean[slot] = counts["toxic"].to_numpy(), counts["clean"].to_numpy()
    ratio = ratios(in_toxic, in_clean, positives, n, least_df, least_ratio)
    used = ratio != 0

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.frombuffer(b.as_buffer(), "<u4") for b in batch.column("slots")]
            yield batch.set_column(2, "slots", pa.array([s[used[s]].tobytes() for s in slots], pa.binary()))

    left = rows.mapInArrow(Lean(kept), rows.schema).toArrow().sort_by("doc_id")
    return fit([np.frombuffer(b.as_buffer(), "<u4") for b in left["slots"]], left["toxic"].to_numpy().astype(np.int64), ratio)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) to every row."""
    rest = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*rest, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.weights != 0
        for batch in batches:
            for part in chunks(batch, text):
                of, slot = presences(*flat(part.column(text)), known)
                z = np.bincount(of, model.weights[slot], part.num_rows) + model.intercept
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*[f.name for f in rest], "score", "predicted"])

    return df.mapInArrow(Lean(run), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
