"""A corpus pipeline of five stages over `documents`; each stage's result is written and read again as the next one's input.

Toxic documents go; of each group of near-duplicates (five-word shingles, 0.8)
the document of smallest doc_id stays; passages of 200 bytes that repeat are
removed from the texts; secrets are replaced by a mark of their kind; what is
left is tokenized and packed into sequences of 2048 tokens.

Every stage but the last returns the columns of documents, with n_chars
following the text. Documents whose text is emptied by a stage stay, with an
empty text; null texts stay null where nothing is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import minhash, packing, secrets, suffix, toxicity
from loglattice.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MAX_BROADCAST_KEYS = 500_000


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(minhash.near_duplicates(docs, minhash.Settings()).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "kept"), "kept")
    dropped = found.filter("not kept").select("_d", "_h").distinct()
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_t"))

    def side(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys

    same = lambda: F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h"))
    left = hashed.join(side(dropped), same(), "left_anti")
    twice = written(found.filter("kept").groupBy("_d", "_h").agg(F.count("*").alias("n")).filter("n > 1").select("_d", "_h"), "twice")
    if not twice.isEmpty():
        left = left.join(side(twice), same(), "left_anti").union(left.join(side(twice), same(), "left_semi").dropDuplicates(["doc_id", "_t"]))
    return left.select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), real=False)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeated_passages),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Training, hashing and tokenizing have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
