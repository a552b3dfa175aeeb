"""Templates of id sequences: clusters of a bounded sample folded to common subsequences, matched with gaps against all rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.similarity import WILD, folded_template, gap_match, lcs
from loglattice.operators.cluster import SAMPLE, complete_linkage
from loglattice.operators.order import hash_rank


def matched_sequences(rows: DataFrame, seq: str, templates: list[list[str]]) -> DataFrame:
    """Add template (index of the first that fits, -1 for none) and parts (what its gaps hold). Templates are at most SAMPLE per call."""

    @F.pandas_udf(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.StringType())))]))
    def match(s: pd.Series) -> pd.DataFrame:
        out = []
        for row in s:
            hits = ((i, gap_match(t, list(row))) for i, t in enumerate(templates))
            out.append(next(((i, p) for i, p in hits if p is not None), (-1, None)))
        return pd.DataFrame(out, columns=["template", "parts"])

    return rows.withColumn("_m", match(F.col(seq))).withColumn("template", F.col("_m.template")).withColumn("parts", F.col("_m.parts")).drop("_m")


def cluster_templates(sample: DataFrame, labels: DataFrame, key: str, seq: str, least: int) -> list[list[str]]:
    """Folded templates of the sample's clusters with at least `least` fixed items; the sample is bounded, so are they."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": [folded_template([list(r) for r in pdf.sort_values(key)[seq]])]})

    rows = sample.join(labels, key).groupBy("cluster").applyInPandas(fold, "t array<string>").collect()
    found = {tuple(r.t) for r in rows if sum(x != WILD for x in r.t) >= least}
    return [list(t) for t in sorted(found, key=lambda t: (-sum(x != WILD for x in t), t))]


def sequence_templates(rows: DataFrame, key: str, seq: str, vec: str, threshold: float, least: int = 2, rounds: int = 20, seed: str = "0") -> tuple[DataFrame, list[list[str]]]:
    """(key, template) of all rows and the templates: sample, cluster, fold, match, repeat on the rest while more than SAMPLE are left and something matches."""
    left, done, every = rows.select(key, seq, vec), None, []
    for number in range(rounds):
        if left.count() <= SAMPLE and number:
            break
        sample = hash_rank(left, f"{seed}-{number}", key, SAMPLE)
        fresh = cluster_templates(sample, complete_linkage(sample, key, vec, threshold), key, seq, least)
        if not fresh:
            break
        hit = matched_sequences(left, seq, fresh).checkpoint()
        found = hit.filter("template >= 0").select(key, (F.col("template") + len(every)).alias("template"))
        if found.isEmpty():
            break
        done = found if done is None else done.union(found)
        every += fresh
        left = hit.filter("template < 0").select(key, seq, vec)
    rest = left.select(key, F.lit(-1).alias("template"))
    return (rest if done is None else done.union(rest)), every


def adaptive_patterns(rows: list[list[str]], same: float = 0.2, different: float = 0.6) -> list[list[str]]:
    """Patterns grown from a bounded sample: a row near one merges into it, a row far from all becomes a new one, others are passed over."""
    patterns: list[list[str]] = []
    for row in rows:
        fixed = [[x for x in p if x != WILD] for p in patterns]
        away = [1 - lcs(f, row)[0] / max(len(f), 1) for f in fixed]
        if away and min(away) <= same:
            k = away.index(min(away))
            patterns[k] = folded_template([patterns[k], row])
        elif not away or min(away) > different:
            patterns.append(list(row))
    return patterns
