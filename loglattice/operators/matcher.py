"""Matching lines to templates, failure classes and slots; one map over the lines with a small broadcast table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import text as X
from loglattice.operators.templates import MAX_TEMPLATES, WILD

MAX_CHARS, MAX_TOKENS, MAX_SLOTS = 300_000, 2_048, 128


def buckets(templates: DataFrame) -> DataFrame:
    """(n_tokens, bucket): the templates of a length as an ordered array. At most MAX_TEMPLATES are accepted, so the table may be broadcast."""
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return templates.groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("eid", "tokens", "slots"))).alias("bucket"))


def fits(template: Column, tokens: Column) -> Column:
    return F.forall(F.zip_with(template, tokens, lambda a, b: (a == WILD) | (a == b)), lambda ok: ok)


def failure(line: Column, content: Column | None = None, n_tokens: Column | None = None) -> Column:
    """Why a record can't be loaded, in order of the tests; null if it can."""
    out = F.when(F.length(F.trim(line)) == 0, "empty").when(F.instr(line, "\0") > 0, "bad_char").when(F.length(line) > MAX_CHARS, "too_long")
    if content is not None:
        out = out.when(F.length(content) == 0, "no_content")
    if n_tokens is not None:
        out = out.when(n_tokens >= MAX_TOKENS, "too_many_tokens")
    return out


def matched(lines: DataFrame, templates: DataFrame, head_length: int = 0, layout: list | None = None) -> DataFrame:
    """Add head, eid (-1 not loaded, 0 no template), fail_reason, vars to every line.

    The templates of the line's token count come by a broadcast hash join, one
    row per line; the first of them that fits is taken from the array, so lines
    are neither multiplied nor shuffled. Headers that don't fit the layout's
    rows, where one is given, are of the wrong format.
    """
    head = X.head_of(F.col("line"), head_length) if head_length else F.lit("")
    rows = lines.withColumn("head", head)
    content = F.substr("line", F.length("head") + 1, F.length("line"))
    rows = rows.withColumn("_content", content).withColumn("tokens", X.match_tokens(F.col("_content"))).withColumn("_n", F.size("tokens"))
    bad = failure(F.col("line"), F.col("_content"), F.col("_n"))
    if head_length:
        bad = F.coalesce(bad, F.when((F.col("head") == "") | ~X.fits_layout(F.col("head"), layout or []), "wrong_format"))
    joined = rows.withColumn("fail_reason", bad).join(F.broadcast(buckets(templates)), F.col("_n") == F.col("n_tokens"), "left")
    first = F.get(F.filter("bucket", lambda t: fits(t["tokens"], F.col("tokens"))), F.lit(0))
    joined = joined.withColumn("_hit", F.when(F.col("fail_reason").isNull(), first))
    many = F.size("_hit.slots") > MAX_SLOTS
    joined = joined.withColumn("fail_reason", F.when(many, "too_many_variables").otherwise(F.col("fail_reason")))
    eid = F.when(F.col("fail_reason").isNotNull(), -1).otherwise(F.coalesce("_hit.eid", F.lit(0))).cast("int")
    values = F.transform("_hit.slots", lambda i: F.get("tokens", i))
    return joined.select(*lines.columns, "head", eid.alias("eid"), "fail_reason", F.when(eid > 0, values).alias("vars"))


def slot_values(parsed: DataFrame) -> DataFrame:
    """(rec_no, eid, slot, value)."""
    return parsed.filter("eid > 0").select("rec_no", "eid", F.posexplode("vars").alias("slot", "value"))


def load_statistics(parsed: DataFrame) -> DataFrame:
    """(reason, n): records per failure reason; loaded for the others."""
    return parsed.groupBy(F.coalesce("fail_reason", F.lit("loaded")).alias("reason")).agg(F.count("*").alias("n"))


def filled(template: Column, values: Column) -> Column:
    """Template tokens with the wildcards replaced left to right."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    step = lambda acc, t: F.struct((acc["k"] + F.when(t == WILD, 1).otherwise(0)).alias("k"), F.concat(acc["out"], F.when(t == WILD, F.get(values, acc["k"])).otherwise(t)).alias("out"))
    return F.aggregate(template, start, step, lambda acc: acc["out"])
