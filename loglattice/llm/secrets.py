"""Secret scan (native: DataFrame functions only, no shuffle).

Base kinds, leftmost non-overlapping each: assign (a secret's name, a
separator and a value of 6 or more characters; the span is the whole match),
access (access key ids of 20 or more characters) and hex (24 or more digits).

The method adds spans of kind entropy: candidate strings are maximal runs of
20 or more of [A-Za-z0-9+/_=-] that hold a letter and a digit. A window of
20 characters slides over a candidate; the number of each character in it is
kept incrementally (one enters, one leaves), and with it the sum of c*log2(c)
in millionths, so the largest Shannon entropy of any window is found in one
pass with integers only. A candidate counts if that entropy reaches the limit
of its character class: 3.0 bits for hexadecimal strings, 3.5 for letters and
digits, 3.75 for strings with other characters. Suppressed are candidates that
the allow-list knows (UUIDs, runs of the alphabet or of digits, placeholder
words, file paths and words joined by - or _), and those that overlap a base
span.

Cases: null text counts as empty and gives no spans and the digest of the
empty string. `scan` replaces columns of its own names (base, added, spans, _text,
_assign, _access, _hex, _found); `redact` keeps all. Rows are kept one to one, repeated rows included; texts of any
length are scanned whole. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
NAMES = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key") + ")"
ASSIGN = NAMES + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Items of a block in running results.
STRIDE = 256
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Largest sum of c*log2(c), in millionths, of a window whose entropy reaches the class's limit in bits.
LIMITS = {name: round((math.log2(WINDOW) - bits) * WINDOW * 1e6) for name, bits in (("hex", 3.0), ("alnum", 3.5), ("other", 3.75))}
C_LOG_C = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
#: The last one, on paths, is evaluated piece by piece in Spark (`joined_words`): a repeated group would recurse there.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?:abcdefgh|ABCDEFGH|01234567|12345678|EXAMPLE|example|xxxx|XXXX)",
    "^/?(?:[A-Za-z]*[0-9]?[A-Za-z]*[/_-])+[A-Za-z]*[0-9]{0,4}$",
)
SPAN = "array<struct<start:bigint,kind:int,end:bigint,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative step over an array of longs, in blocks, so that no long array is copied for each of its items."""
    zero_ = F.lit(zero).cast("bigint")
    grow = lambda acc, v: F.array_append(acc, step(F.element_at(acc, -1), v))

    def of(items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STRIDE).cast("int")), lambda k: F.slice(items, k * STRIDE + 1, F.lit(STRIDE)))
        return let(parts, lambda some: F.flatten(F.zip_with(some, F.aggregate(F.transform(some, lambda p: F.aggregate(p, zero_, step)), F.array(zero_), grow), lambda p, base: F.when(p.isNotNull(), F.slice(F.aggregate(p, F.array(base), grow), 2, F.size(p))).otherwise(F.array().cast("array<bigint>")))))

    return let(values, lambda items: F.when(F.size(items) > 0, of(items)).otherwise(F.array().cast("array<bigint>")))


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches, from the gaps between them; with least, only those whose group has so many characters."""
    none = F.array().cast(SPAN)

    def spans(found: Column) -> Column:
        ends = running(F.zip_with(found["gap"], found["hit"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint")), 0, lambda a, b: a + b)
        rows = F.arrays_zip(ends.alias("end"), found["hit"].alias("hit"), found["part"].alias("part"))
        kept = F.filter(rows, lambda x: x["hit"].isNotNull() & (F.length(x["part"]) >= least))
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit")))

    found = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(none)


def apart(found: Column, base: Column) -> Column:
    """The spans of `found` that overlap none of `base`: the farthest end of the base spans that begin before a span's end is not beyond its start."""
    events = F.sort_array(F.concat(F.transform(found, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).cast("bigint").alias("far"), s.alias("span"))), F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("far"), b.alias("span")))))

    def clear(rows: Column) -> Column:
        far = running(F.transform(rows, lambda r: r["far"]), 0, lambda a, b: F.greatest(a, b))
        return F.transform(F.filter(F.zip_with(rows, far, lambda r, f: F.struct(r["base"].alias("base"), f.alias("far"), r["span"].alias("span"))), lambda x: (x["base"] == 0) & (x["far"] <= x["span"]["start"])), lambda x: x["span"])

    return F.when(F.size(base) == 0, found).otherwise(let(events, clear))


def lowest_sum(candidate: Column) -> Column:
    """Smallest sum of c*log2(c) over all windows of a candidate: the window of largest entropy."""
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    table = F.array(*map(F.lit, C_LOG_C))
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("into"), i.alias("i")))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("best"), F.array().cast("array<int>").alias("recent"))

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["recent"]) == WINDOW
        out = F.when(full, acc["recent"][0]).otherwise(F.lit(-1))
        more, less = F.get(acc["n"], x["into"]), F.get(acc["n"], out)
        change = F.get(table, more + 1) - F.get(table, more) - F.when(full, F.get(table, less) - F.get(table, less - 1)).otherwise(0)
        total = acc["sum"] + F.when(out == x["into"], F.lit(0)).otherwise(change)
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == x["into"], 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
        best = F.when(x["i"] >= WINDOW - 1, F.least(acc["best"], total)).otherwise(acc["best"])
        recent = F.array_append(F.when(full, F.slice(acc["recent"], 2, WINDOW - 1)).otherwise(acc["recent"]), x["into"])
        return F.struct(counts.alias("n"), total.alias("sum"), best.alias("best"), recent.alias("recent"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def joined_words(hit: Column) -> Column:
    """ALLOWED[-1]: pieces between / _ - with at most one digit each, the last one letters and then at most four digits."""
    pieces = F.split(hit, "[/_-]")
    return let(pieces, lambda p: (F.size(p) > 1) & F.element_at(p, -1).rlike("^[A-Za-z]*+[0-9]{0,4}$") & F.forall(F.slice(p, 1, F.size(p) - 1), lambda x: x.rlike("^[A-Za-z]*+[0-9]?+[A-Za-z]*+$")))


def suspicious(hit: Column) -> Column:
    limit = F.when(hit.rlike("^[0-9a-fA-F]+$"), LIMITS["hex"]).when(hit.rlike("^[A-Za-z0-9]+$"), LIMITS["alnum"]).otherwise(LIMITS["other"])
    fresh = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    for pattern in ALLOWED[:-1]:
        fresh = fresh & ~hit.rlike(pattern)
    fresh = fresh & ~joined_words(hit)
    return fresh & F.when(fresh, lowest_sum(hit) <= limit)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add base and spans (arrays of start, kind, end, hit; sorted by start, then kind) to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_text", body).withColumn("_assign", located(F.col("_text"), ASSIGN, 0, 1, 6)).withColumn("_access", located(F.col("_text"), ACCESS, 1)).withColumn("_hex", located(F.col("_text"), HEX, 2)).withColumn("_found", located(F.col("_text"), CANDIDATE, 3))
    out = out.withColumn("base", F.concat("_assign", "_access", "_hex"))
    added = F.filter(apart(F.col("_found"), F.col("base")), lambda s: suspicious(s["hit"]))
    out = out.withColumn("added", F.when(F.size("_found") > 0, added).otherwise(F.array().cast(SPAN)))
    return out.withColumn("spans", F.sort_array(F.concat("base", "added")))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its texts replaced by [kind]; overlapping spans give one mark, that of the first."""
    names = F.array(*map(F.lit, KINDS))
    done = scan(df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_body")), "_body")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr("_text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr("_text", (acc["at"] + 1).cast("int"), F.length("_text"))))
    return done.select(*[(F.when(F.size("spans") > 0, clean).otherwise(F.col("_body")) if c == text else F.col("_row")[c]).alias(c) for c in df.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda name: F.size(name).cast("long")
    return scan(docs).select("doc_id", count("_assign").alias("n_assign"), count("_access").alias("n_access"), count("_hex").alias("n_hex"), count("added").alias("n_entropy"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _sql_spans(pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""select r, {kind} as kind, hit, part,
      (sum(length(gap) + coalesce(length(hit), 0)) over (partition by r order by i) - length(hit))::bigint as s
      from (select r, unnest(regexp_split_to_array(text, '{p}')) as gap, unnest(regexp_extract_all(text, '{p}', 0)) as hit,
            unnest(regexp_extract_all(text, '{p}', {group})) as part, unnest(range(len(regexp_split_to_array(text, '{p}')))) as i
            from d where regexp_matches(text, '{p}'))
      qualify hit is not null and length(part) >= {least}"""


OP3_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
b as ({_sql_spans(ASSIGN, 0, 1, 6)} union all {_sql_spans(ACCESS, 1)} union all {_sql_spans(HEX, 2)}),
f as ({_sql_spans(CANDIDATE, 3)}),
g as (select f.*, row_number() over () as k from f
      where regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]')
        {"".join(f" and not regexp_matches(hit, '{p}')" for p in ALLOWED)}
        and not exists (select 1 from b where b.r = f.r and b.s < f.s + length(f.hit) and f.s < b.s + length(b.hit))),
w as (select k, i, substr(substr(hit, i, {WINDOW}), j, 1) as ch, count(*) as n
      from g, unnest(range(1, length(hit) - {WINDOW} + 2)) as x(i), unnest(range(1, {WINDOW} + 1)) as y(j) group by k, i, ch),
e as (select k, min(t) as low from (select k, i, sum(list_extract([{", ".join(map(str, C_LOG_C[1:]))}], n)) as t from w group by k, i) group by k),
a as (select g.r, g.kind, g.hit, g.part, g.s from g join e using (k)
      where low <= case when regexp_matches(hit, '^[0-9a-fA-F]+$') then {LIMITS['hex']} when regexp_matches(hit, '^[A-Za-z0-9]+$') then {LIMITS['alnum']} else {LIMITS['other']} end),
u as (select *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || (s + length(hit)) as t from (select * from b union all select * from a)),
c as (select r, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, count(*) filter (kind = 3) as n3,
      string_agg(t, ',' order by s, kind) filter (kind < 3) as base, string_agg(t, ',' order by s, kind) as spans from u group by r)
select d.doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex, coalesce(n3, 0)::bigint as n_entropy,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join c using (r)
"""
