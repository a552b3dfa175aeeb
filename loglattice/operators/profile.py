"""Column analysis on the long form (scope, eid, col, pos, value): distinct share, numeric test, entropy, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text as X

KEY = ["scope", "eid", "col"]
DISTINCT_SHARE = 0.5


def column_profile(cols: DataFrame, by: list[str] = KEY) -> DataFrame:
    """n, n_distinct, is_num (canonical integers only), fixed_length of all-digit columns of one length, else null."""
    digits = F.bool_and(F.col("value").rlike(X.FIXED_DIGITS))
    same = F.min(F.length("value")) == F.max(F.length("value"))
    return cols.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.bool_and(X.is_integer(F.col("value"))).alias("is_num"), F.when(digits & same, F.min(F.length("value"))).cast("bigint").alias("fixed_length"))


def weighted_entropy(values: DataFrame, value: str, by: list[str], name: str = "h") -> DataFrame:
    """-sum p ln p log2(|v|+1) over the distinct values of each group."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_t")) if by else counts.agg(F.sum("_n").alias("_t"))
    joined = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))
    p = F.col("_n") / F.col("_t")
    term = -p * F.log(p) * F.log2(F.abs(F.col(value)).cast("double") + 1)
    return joined.groupBy(*by).agg((F.sum(term) + 0.0).alias(name))


def deltas(values: DataFrame, value: str, by: list[str], order: str = "pos") -> DataFrame:
    """Add delta (difference to the row before; null in the first) and encoded (the first value kept). Windows run per column and block."""
    w = Window.partitionBy(*by).orderBy(order)
    d = F.col(value) - F.lag(value).over(w)
    return values.withColumn("delta", d).withColumn("encoded", F.coalesce(d, F.col(value)))


def undeltas(encoded: DataFrame, by: list[str], order: str = "pos", value: str = "encoded") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return encoded.withColumn("restored", F.sum(value).over(w))


def delta_rule(values: DataFrame, value: str, by: list[str], order: str = "pos") -> DataFrame:
    """(by, h_raw, h_delta, use_delta): delta if its entropy is no larger."""
    d = deltas(values, value, by, order)
    raw = weighted_entropy(d, value, by, "h_raw")
    diff = weighted_entropy(d.filter("delta is not null"), "delta", by, "h_delta")
    return raw.join(diff, by, "left").withColumn("h_delta", F.coalesce("h_delta", F.lit(0.0))).withColumn("use_delta", F.col("h_raw") >= F.col("h_delta"))


def dictionary(cols: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, value, id): ids from 0 by first appearance within each group `by` (a block, usually)."""
    first = cols.groupBy(*by, "value").agg(F.min(F.struct(*order)).alias("first"))
    return first.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("first")).cast("bigint") - 1).drop("first")


def encoding_plan(cols: DataFrame, by: list[str] = KEY, share: float = DISTINCT_SHARE) -> DataFrame:
    """(by, kind): delta, integer, fixed, dictionary or string, in that order of preference."""
    profile = column_profile(cols, by)
    numeric = cols.join(profile.filter("is_num").select(*by), by).withColumn("number", F.col("value").cast("bigint"))
    rule = delta_rule(numeric, "number", by).select(*by, "use_delta")
    kind = F.when(F.col("is_num") & F.col("use_delta"), "delta").when(F.col("is_num"), "integer").when(F.col("fixed_length").isNotNull(), "fixed").when(F.col("n_distinct") < share * F.col("n"), "dictionary").otherwise("string")
    return profile.join(rule, by, "left").select(*by, "n", "n_distinct", kind.alias("kind"))


def signatures(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy(X.signature(F.col(value)).alias("signature")).agg(F.count("*").alias("n"))


def split_pattern(value, pattern: str):
    """Parts of a value around the pattern's delimiters, each taken at its next occurrence; delimiters are not kept in parts.

    A delimiter that is missing gives an empty part and leaves the rest as it is.
    """
    start = F.struct(value.alias("rest"), F.array().cast("array<string>").alias("parts"))

    def step(acc, d):
        at = F.instr(acc["rest"], d)
        part = F.substr(acc["rest"], F.lit(1), F.greatest(at - 1, F.lit(0)))
        return F.struct(F.when(at > 0, F.substr(acc["rest"], at + 1, F.length(acc["rest"]))).otherwise(acc["rest"]).alias("rest"), F.array_append(acc["parts"], part).alias("parts"))

    return F.aggregate(F.array(*map(F.lit, pattern)), start, step, lambda acc: F.array_append(acc["parts"], acc["rest"]))


def joined_pattern(parts, pattern: str):
    """Parts and delimiters interleaved again."""
    return F.array_join(F.zip_with(parts, F.array(*map(F.lit, pattern), F.lit("")), lambda p, d: F.concat(p, d)), "")


def string_lcs(a: str, b: str) -> str:
    """Longest common subsequence; where both ways are equally long the one that skips in the first string."""
    n, m = len(a), len(b)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return "".join(out)


def common_pattern(values: DataFrame, value: str, by: list[str], order: str, most: int = 10_000) -> DataFrame:
    """(by, pattern): the LCS fold over a column's distinct signatures in order of appearance.

    Folding over all rows gives the same; only distinct signatures, at most
    `most` of them, leave Spark's side. A column with more has no common pattern
    worth a split and gets the empty one.
    """
    import pandas as pd

    keyed = values.withColumn("_all", F.lit(0)) if not by else values
    keys = by or ["_all"]
    firsts = keyed.groupBy(*keys, X.signature(F.col(value)).alias("s")).agg(F.min(order).alias("first"))
    many = firsts.groupBy(*keys).agg(F.count("*").alias("m"))
    few = firsts.join(many.filter(F.col("m") <= most), keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pattern = None
        for s in pdf.sort_values("first").s:
            pattern = s if pattern is None else string_lcs(pattern, s)
            if not pattern:
                break
        return pdf[keys].head(1).assign(pattern=pattern or "")

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name in keys] + ["pattern string"])
    found = few.groupBy(*keys).applyInPandas(fold, schema)
    out = many.select(*keys).join(found, keys, "left").withColumn("pattern", F.coalesce("pattern", F.lit("")))
    return out.drop("_all")
