"""URL filter: rules on hosts and path prefixes, found by an equi-join on short hash prefixes.

A rule is (action, host, path) and fits a URL of that host or a subdomain whose
path starts with the rule's path. Each URL is expanded into host-suffix and
path-prefix expressions, only for the numbers of labels and the path lengths
that some rule has, so the number of expressions is bounded by the rules and
nothing that fits is missed. The first 8 hex digits of an expression's SHA-256
are the only join key; of the rules that share a prefix, those of the same full
digest are kept after the join, and of several rules the longest wins (then the longer host, then block before allow). URLs
without a rule get `default`.

The rules are broadcast while they are at most `max_broadcast`; beyond that
the same join is shuffled.

Cases: a null URL or one without :// has an empty host and path and fits no
rule; rows are kept one to one, repeated rows included; extra columns of any
name pass through unless they are named host, path, rule or verdict, which are
replaced. With no rules every URL gets the default; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MAX_BROADCAST = 100_000
KEY = 8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    labels = F.split(host, "\\.")
    hosts = F.filter(F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, F.size(labels) - k + 1, F.lit(k)), ".")) for k in label_counts]), lambda h: h.isNotNull())
    paths = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Add host, path, rule and verdict to every row."""
    expr = F.concat("host", "path")
    known = rules.groupBy("host", "path").agg(F.max_by("action", F.col("action") == "block").alias("action"))
    known = known.select(F.struct(F.sha2(expr, 256).alias("digest"), F.length(expr).alias("size"), F.length("host").alias("host_size"), F.col("action").alias("action"), expr.alias("rule")).alias("rule"))
    # one row for each prefix, so that a prefix that two rules share multiplies no rows
    known = known.groupBy(F.substring("rule.digest", 1, KEY).alias("key")).agg(F.collect_list("rule").alias("rules"))
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # the caller's columns stay in a struct meanwhile, so no name of theirs can clash
    rows = pages.select(F.struct(*rest).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("r"))
    if not shape.n:
        return rows.select(*[F.col("row")[c].alias(c) for c in rest], "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = rows.withColumn("digest", F.explode_outer(F.transform(expressions(F.col("host"), F.col("path"), sorted(shape.labels), sorted(shape.lengths)), lambda e: F.sha2(e, 256)))).withColumn("key", F.substring("digest", 1, KEY))
    found = asked.join(F.broadcast(known) if shape.n <= max_broadcast else known, "key", "left")
    exact = F.array_max(F.transform(F.filter("rules", lambda x: x["digest"] == F.col("digest")), lambda x: F.struct(x["size"], x["host_size"], x["action"].alias("action"), x["rule"].alias("rule"))))
    out = found.groupBy("r").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(exact).alias("best"))
    return out.select(*[F.col("row")[c].alias(c) for c in rest], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def rule_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])).alias("r")).select("r.*")


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, rule_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = f"""
with rules(action, host, path) as (values {", ".join(map(str, RULES))}),
p as (select row_number() over () as r, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
m as (select p.r, arg_max(struct_pack(rule := rules.host || rules.path, action := rules.action), length(rules.host || rules.path)) as best
      from p join rules on (p.host = rules.host or ends_with(p.host, '.' || rules.host)) and starts_with(p.path, rules.path) group by p.r)
select page_id, p.host, p.path, m.best.rule as rule, coalesce(m.best.action, 'allow') as verdict from p left join m using (r)
"""
