"""Connected components of a graph given as a table of links, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label) for every end of a link (columns a, b): the smallest v that can be reached.

    Each round takes the smallest label among the neighbours and then follows
    the label's own label, so long chains shrink by halves. Both steps are
    joins against one row per vertex, hence a hot vertex or label is only a
    skewed probe side, which adaptive execution splits. Tables are written each
    round: a lost executor costs no earlier round. Self-links and repeated
    links are allowed; no links give no rows.
    """
    both = written(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "links")
    labels = written(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("_near"))
        stepped = labels.join(near, "v").select("v", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        own = labels.select(F.col("v").alias("label"), F.col("label").alias("_next"))
        jumped = written(stepped.join(own, "label").select("v", "_old", F.least("label", "_next").alias("label")), "labels")
        if jumped.filter("label <> _old").isEmpty():
            return jumped.drop("_old")
        labels = jumped.drop("_old")
    raise RuntimeError(f"labels still change after {rounds} rounds")
