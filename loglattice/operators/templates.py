"""Message templates: relational mining by signature, and an order-dependent prefix-tree trainer on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import text as X
from loglattice.sources.scratch import written

WILD = X.WILDCARD
MAX_TEMPLATES = 1_000


def template_counts(lines: DataFrame) -> DataFrame:
    """(sig, n): lines with every token that has a digit masked."""
    sig = F.array_join(X.masked_digits(X.match_tokens(F.col("line"))), "")
    return lines.select(sig.alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))


def wild_tokens(lines: DataFrame) -> DataFrame:
    """(sig, pos, tok): of every line, an empty token at 0, and counted from 1 the tokens that are wildcards in its signature."""
    toks = X.match_tokens(F.col("line"))
    tokens = lines.select(F.array_join(X.masked_digits(toks), "").alias("sig"), F.posexplode(F.concat(F.array(F.lit("")), toks)).alias("pos", "tok"))
    return tokens.filter((F.col("pos") == 0) | X.has_digit(F.col("tok")) | (F.col("tok") == WILD))


def surveyed(lines: DataFrame) -> DataFrame:
    """(sig, pos, n, a, b), written: counts, and the least and largest hash of the wild tokens; one pass, as longs are summed up without a sort where texts are not."""
    hashed = F.xxhash64("tok")
    return written(wild_tokens(lines).groupBy("sig", "pos").agg(F.count("*").alias("n"), F.min(hashed).alias("a"), F.max(hashed).alias("b")), "survey")


def merged_templates(lines: DataFrame, survey: DataFrame | None = None) -> DataFrame:
    """(sig, pos, token): of the lines of a signature, a position with one token keeps it, others become wildcards.

    A token without digits stands in the signature itself, so only those that
    are wildcards there are compared over the lines: first by hash, and where
    all hashes agree by the tokens themselves.
    """
    survey = surveyed(lines) if survey is None else survey
    found = survey.filter("pos = 0").select("sig", F.posexplode(X.match_tokens(F.col("sig"))).alias("pos", "token"))
    alike = survey.filter("pos > 0 and a = b").select("sig", "pos")
    if alike.isEmpty():
        return found
    spread = wild_tokens(lines).join(alike, ["sig", "pos"], "left_semi").groupBy("sig", (F.col("pos") - 1).alias("pos")).agg(F.min("tok").alias("a"), F.max("tok").alias("b"))
    return found.join(spread, ["sig", "pos"], "left").select("sig", "pos", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("token")).alias("token"))


def templates_of(lines: DataFrame, least_support: int = 1) -> DataFrame:
    """(eid, tokens, n_tokens, slots, support, text): merged templates by descending support, ids from 1."""
    survey = surveyed(lines)
    merged = merged_templates(lines, survey).groupBy("sig").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    counted = merged.join(survey.filter("pos = 0").select("sig", "n"), "sig").filter(F.col("n") >= least_support)
    return numbered(counted.select("tokens", F.col("n").alias("support")))


def numbered(templates: DataFrame) -> DataFrame:
    """Ids in order of support, then text. Of more than MAX_TEMPLATES one too many is kept, so that `bounded` and the matcher refuse them; the bound makes one window task enough."""
    from pyspark.sql import Window

    best = templates.withColumn("text", F.array_join("tokens", "")).orderBy(F.col("support").desc(), "text").limit(MAX_TEMPLATES + 1)
    slots = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == WILD)
    ranked = best.withColumn("eid", F.row_number().over(Window.orderBy(F.col("support").desc(), "text")).cast("int"))
    return ranked.select("eid", "tokens", F.size("tokens").alias("n_tokens"), slots.alias("slots"), "support", "text")


def bounded(templates: DataFrame) -> DataFrame:
    """The templates as a local table, mined once; more than MAX_TEMPLATES are refused."""
    rows = templates.collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return templates.sparkSession.createDataFrame(rows, templates.schema)


def separates(token: str) -> bool:
    """Blank runs, tabs, line ends, colons, commas, equals signs."""
    return token.isspace() or token in (":", ",", "=")


def pruned(templates: DataFrame, least_support: int = 2) -> DataFrame:
    """Without templates seen less often."""
    return templates.filter(F.col("support") >= least_support)


@dataclass
class Cluster:
    tokens: list[str]
    support: int = 1


@dataclass
class Branch:
    children: dict[str, Branch] = field(default_factory=dict)
    clusters: list[Cluster] = field(default_factory=list)


class TreeTrainer:
    """Online clustering of token lists: by length, then by leading tokens, then by similarity; a match merges into its template at once."""

    def __init__(self, similarity: float = 0.1, depth: int = 5, width: int = 99):
        self.similarity, self.depth, self.width = similarity, depth, width
        self.by_length: dict[int, Branch] = {}
        self.clusters: list[Cluster] = []

    def score(self, template: list[str], tokens: list[str]) -> tuple[float, int]:
        """Share of equal tokens that aren't separators, and the number of wildcards; -1 where a separator is out of line."""
        equal = wild = 0
        for t, x in zip(template, tokens):
            if t == WILD:
                wild += 1
            elif t != x and separates(t):
                return -1.0, 0
            else:
                equal += t == x and not separates(t)
        return equal / max(1, len(tokens)), wild

    def leaf(self, tokens: list[str], grow: bool) -> Branch | None:
        node = self.by_length.setdefault(len(tokens), Branch()) if grow else self.by_length.get(len(tokens))
        for token in tokens[: min(self.depth, len(tokens) - 1)]:  # not the last token, so that short lines can merge in it
            if node is None:
                return None
            if token in node.children:
                node = node.children[token]
                continue
            key = token if not any(c.isdigit() for c in token) and len(node.children) < self.width else WILD
            node = node.children.setdefault(key, Branch()) if grow else node.children.get(WILD)
        return node

    def find(self, tokens: list[str]) -> Cluster | None:
        node = self.leaf(tokens, grow=False)
        scored = [(*self.score(c.tokens, tokens), -i, c) for i, c in enumerate(node.clusters)] if node else []
        best = max(scored, key=lambda s: s[:3], default=None)
        return best[3] if best and best[0] >= self.similarity else None

    def add(self, tokens: list[str]) -> Cluster:
        found = self.find(tokens)
        if found:
            found.tokens = [a if a == b else WILD for a, b in zip(found.tokens, tokens)]
            found.support += 1
            return found
        new = Cluster(list(tokens))
        self.clusters.append(new)
        self.leaf(tokens, grow=True).clusters.append(new)
        return new

    def show(self) -> str:
        out = []

        def walk(node: Branch, key: str, level: int) -> None:
            out.append("  " * level + key + "".join(f" [{c.support}] {''.join(c.tokens)}" for c in node.clusters))
            for k, child in node.children.items():
                walk(child, k, level + 1)

        for n, node in sorted(self.by_length.items()):
            walk(node, str(n), 0)
        return "\n".join(out)


def trained_templates(sample: DataFrame, similarity: float = 0.1, depth: int = 5, width: int = 99) -> DataFrame:
    """(eid, tokens, n_tokens, slots, support, text) learned in line order from a bounded sample (see chunk_sample), in one task."""
    tokens = sample.select(F.lit(0).alias("g"), "rec_no", X.masked_numbers(X.match_tokens(F.col("line"))).alias("tokens"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        trainer = TreeTrainer(similarity, depth, width)
        for tokens in pdf.sort_values("rec_no").tokens:
            trainer.add(list(tokens))
        return pd.DataFrame([(c.tokens, c.support) for c in trainer.clusters], columns=["tokens", "support"])

    return numbered(tokens.groupBy("g").applyInPandas(train, "tokens array<string>, support long"))
