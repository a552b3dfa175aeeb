"""Header layout inference: how many digit and literal parts each field has, which are fixed, and the usual separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text as X

SHARE, SAMPLE = 0.95, 5000


def header_values(lines: DataFrame, length: int, sample: int | None = SAMPLE) -> DataFrame:
    """(rec_no, field, value, delim, parts) of the header fields; with `sample` of the first so many lines that have a header, whatever their rec_no."""
    head = lines.select("rec_no", X.head_of(F.col("line"), length).alias("h")).filter("h <> ''")
    if sample is not None:
        head = head.orderBy("rec_no", "h").limit(sample)
    fields = head.select("rec_no", F.posexplode(F.arrays_zip(X.header_fields(F.col("h")).alias("value"), X.header_separators(F.col("h")).alias("delim"))).alias("field", "x"))
    return fields.select("rec_no", "field", "x.value", "x.delim", X.digit_runs(F.col("x.value")).alias("parts"))


def top(counts: DataFrame, by: list[str], n: str, tie: str) -> DataFrame:
    """Of each group the row of largest n, the smallest tie first."""
    w = Window.partitionBy(*by).orderBy(F.col(n).desc(), F.col(tie))
    return counts.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def part_mode(values: DataFrame) -> DataFrame:
    """(field, n_parts, n, total, formatted): the usual number of parts, and whether it covers enough values."""
    counts = values.groupBy("field", F.size("parts").cast("bigint").alias("n_parts")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    return top(counts, ["field"], "n", "n_parts").join(totals, "field").withColumn("formatted", F.col("n") >= SHARE * F.col("total"))


def layout(values: DataFrame) -> DataFrame:
    """(field, part, piece, length, fixed): for each part of a formatted field its literal or %d and a fixed length or -1.

    A field with a literal part that varies, or of a single literal part, is a
    string and has no rows.
    """
    mode = part_mode(values).filter("formatted").select("field", "n_parts")
    parts = values.join(mode, "field").filter("size(parts) = n_parts").select("field", "n_parts", F.posexplode("parts").alias("part", "p"))
    numeric = F.col("p").rlike("^[0-9]")
    shaped = parts.select("field", "n_parts", "part", F.when(numeric, F.lit("%d")).otherwise(F.col("p")).alias("piece"), F.when(numeric, F.length("p")).otherwise(F.lit(0)).cast("bigint").alias("length"))
    totals = shaped.groupBy("field", "part").agg(F.count("*").alias("total"), F.max("n_parts").alias("n_parts"))
    pieces = top(shaped.groupBy("field", "part", "piece").agg(F.count("*").alias("n")), ["field", "part"], "n", "piece")
    lengths = top(shaped.groupBy("field", "part", "length").agg(F.count("*").alias("m")), ["field", "part"], "m", "length")
    both = pieces.join(lengths, ["field", "part"]).join(totals, ["field", "part"])
    both = both.withColumn("ok", F.col("n") >= SHARE * F.col("total")).withColumn("fixed", F.when((F.col("piece") == "%d") & (F.col("m") < SHARE * F.col("total")), F.lit(-1)).otherwise(F.col("length")))
    good = both.groupBy("field").agg(F.min("ok").alias("all_ok"), F.max(F.col("piece") == "%d").alias("any_number")).filter("all_ok and any_number").select("field")
    return both.join(good, "field").select("field", "part", "piece", F.col("fixed").cast("bigint").alias("length"))


def formats(values: DataFrame) -> DataFrame:
    """(field, format): the layout's parts joined, one row per formatted field."""
    return layout(values).groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("format"))


def modal_delimiters(values: DataFrame) -> DataFrame:
    """(field, delim, n): the most frequent separator after each field; the one seen first among equals."""
    counts = values.groupBy("field", "delim").agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    return top(counts, ["field"], "n", "first").select("field", "delim", "n")


def header_numbers(values: DataFrame) -> DataFrame:
    """(rec_no, field, part, number) of all digit parts."""
    parts = values.select("rec_no", "field", F.posexplode("parts").alias("part", "p")).filter(F.col("p").rlike("^[0-9]{1,18}$"))
    return parts.select("rec_no", "field", "part", F.col("p").cast("bigint").alias("number"))
