"""Homomorphic multiset hash of documents (native: DataFrame functions only).

A text's units are its paragraphs (nonempty lines) and, so that texts of one
paragraph have a likeness too, the sentences in them (up to and with a full
stop). Every unit, marked with its kind, is hashed to a wide vector of 64 lanes
of 16 bits (four SHA-256 digests), and a document's fingerprint is the number
of its units and the sum of their vectors, all modulo 2**48. Sums do not depend
on the order of paragraphs; adding or removing units adds or subtracts their
vectors (`combine`), without reading the rest of the text. Texts that differ in
more than the order of paragraphs and line ends have other units.

Written form: 12 hex digits of the count, then 12 for each of the 64 lanes. No
text that a row can hold has 2**32 units, so its lanes never wrap; unions of
many texts may.

Likeness of two fingerprints estimates 2<a,b>/(<a,a>+<b,b>) of the unit
multisets: lanes less their mean are independent with mean 0, so inner products
of the sums estimate inner products of the multiplicities. It is 1 for equal
fingerprints (two empty texts too) and cut to 0..1.

Cases: null text counts as empty (count 0, all lanes 0). Rows are kept one to
one, repeated and tied doc_ids included (ties are ordered by the MD5 of the
text); null doc_ids come first in the order, and ids may span all longs. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import bucketed_with_next

LANES, FIELD_HEX, LANE_MAX = 64, 12, (1 << 16) - 1
FIELD_MASK = (1 << 4 * FIELD_HEX) - 1
PAIR_MASK, LOW_MASK = (LANE_MAX << 32) | LANE_MAX, (1 << 32) - 1
SENTENCE = "[^.\\n]+[.]?|[.]"
#: Units whose 16-bit lanes fit in a sum of 31 bits.
GROUP = 1 << 15


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column) -> Column:
    """p and each paragraph, s and each sentence."""
    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.filter(F.split(whole, "\n"), lambda u: u != ""), lambda u: F.concat(F.lit("p"), u))
    return F.concat(paragraphs, F.transform(F.regexp_extract_all(whole, F.lit(SENTENCE), F.lit(0)), lambda u: F.concat(F.lit("s"), u)))


def packed_lanes(unit: Column) -> Column:
    """32 longs that hold a unit's 64 lanes, two to a long in 32-bit fields, so plain sums add all lanes."""
    digest = F.concat(*[F.sha2(F.concat(F.lit(str(k)), unit), 256) for k in range(4)])
    words = let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.substr(d, k * 16 + 1, F.lit(16)), 16, -10).cast("bigint")))
    return F.flatten(F.transform(words, lambda w: F.array(w.bitwiseAND(F.lit(PAIR_MASK)), F.shiftrightunsigned(w, 16).bitwiseAND(F.lit(PAIR_MASK)))))


def unpacked(sums: Column) -> Column:
    """The 64 lanes in order from 32 sums of packed longs."""
    high, low = lambda v: F.shiftrightunsigned(v, 32), lambda v: v.bitwiseAND(F.lit(LOW_MASK))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: let(F.struct(F.get(sums, 2 * k).alias("a"), F.get(sums, 2 * k + 1).alias("b")), lambda w: F.array(high(w["b"]), high(w["a"]), low(w["b"]), low(w["a"])))))


def fields_of(text: Column) -> Column:
    """The count and the 64 lanes of a text's fingerprint, as an array of longs."""

    def added(some: Column) -> Column:
        sums = F.aggregate(some, F.array_repeat(F.lit(0).cast("bigint"), LANES // 2), lambda acc, u: F.zip_with(acc, packed_lanes(u), lambda a, b: a + b))
        return F.concat(F.array(F.size(some).cast("bigint")), let(sums, unpacked))

    def of(every: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(every) / GROUP).cast("int")), lambda k: F.slice(every, k * GROUP + 1, F.lit(GROUP)))
        return F.when(F.size(every) <= GROUP, added(every)).otherwise(F.aggregate(groups, F.array_repeat(F.lit(0).cast("bigint"), LANES + 1), lambda acc, g: F.zip_with(acc, added(g), lambda a, b: (a + b).bitwiseAND(F.lit(FIELD_MASK)))))

    return let(units(text), of)


def written_form(fields: Column) -> Column:
    return F.array_join(F.transform(fields, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(FIELD_MASK)))), FIELD_HEX, "0")), "")


def read_form(fingerprint: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LANES)), lambda i: F.conv(F.substr(fingerprint, i * FIELD_HEX + 1, F.lit(FIELD_HEX)), 16, 10).cast("bigint"))


def fingerprint(text: Column) -> Column:
    return written_form(fields_of(text))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union (sign 1) or difference (sign -1) of two multisets of units, from their fingerprints alone."""
    return written_form(F.zip_with(read_form(a), read_form(b), lambda x, y: x + y * sign))


def centred(fields: Column) -> Column:
    """Twice the lanes less their mean, in doubles."""
    return F.transform(F.slice(fields, 2, LANES), lambda v: (v * 2 - F.get(fields, F.lit(0)) * LANE_MAX).cast("double"))


def _inner(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def near(a: Column, b: Column) -> Column:
    """Likeness in 0..1 of the fields of two fingerprints whose lanes have not wrapped."""

    def estimate(v: Column) -> Column:
        x, y = v["x"], v["y"]
        return let(F.struct(_inner(x, y).alias("ab"), (_inner(x, x) + _inner(y, y)).alias("norm")), lambda p: F.when(p["norm"] == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p["ab"] * 2 / p["norm"])), 6)))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.struct(centred(a).alias("x"), centred(b).alias("y")), estimate))


def likeness(a: Column, b: Column) -> Column:
    """Likeness in 0..1 of two written fingerprints."""
    return let(F.struct(read_form(a).alias("a"), read_form(b).alias("b")), lambda v: near(v["a"], v["b"]))


def with_lanes(df: DataFrame, unit: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and the 64 lanes _l0.. of a unit, null where it is; in steps, so that each digest and word is computed once."""
    digests = df.select(*keep, *[F.sha2(F.concat(F.lit(str(k)), F.col(unit)), 256).alias(f"_d{k}") for k in range(4)])
    words = digests.select(*keep, *[F.conv(F.substring(f"_d{w // 4}", 16 * (w % 4) + 1, 16), 16, -10).cast("bigint").alias(f"_w{w}") for w in range(16)])
    return words.select(*keep, *[F.shiftrightunsigned(f"_w{k // 4}", 48 - 16 * (k % 4)).bitwiseAND(F.lit(LANE_MAX)).alias(f"_l{k}") for k in range(LANES)])


def compared(docs: DataFrame, n_buckets: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and the fields of the fingerprints of each text, its edited text and the next text (fields, edited_fields, next_fields).

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many of the next document's first. There is one shuffle, which puts every
    text into a bucket of the order together with its successor; there units
    are exploded next to narrow keys and summed, each text's once, and windows
    over the sums hand them to the document before. Sums are those of
    `fields_of`, in generated code.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = bucketed_with_next(plain.withColumn("_tie", F.md5("text")), "doc_id", "_tie", n_buckets)
    order = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").asc_nulls_first(), "_tie")
    led = placed.select("_b", "_g", "doc_id", "text", F.row_number().over(order).alias("_i"), F.lead("text").over(order).alias("_next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = led.select("_b", "_g", "_i", "doc_id", "text", n.cast("bigint").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - half), F.substr("_next", F.lit(1), half)).alias("_edited"))
    keys = ["_b", "_g", "_i", "doc_id", "n_chars", "edited_sha256"]
    some = lambda w, text: F.transform(F.concat(F.array(F.lit(None).cast("string")), units(text)), lambda u: F.struct(F.lit(w).alias("w"), u.alias("u")))
    long = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).select(*keys, F.explode(F.when(F.col("_g") == 0, F.concat(some(0, F.col("text")), some(1, F.col("_edited")))).otherwise(some(0, F.col("text")))).alias("_u"))
    lanes = with_lanes(long.select(*keys, F.col("_u.w").alias("_k"), F.col("_u.u").alias("_u")), "_u", [*keys, "_k"])
    sums = lanes.groupBy(*keys, "_k").agg(F.count("_l0").alias("_n"), *[F.coalesce(F.sum(f"_l{k}"), F.lit(0)).alias(f"_s{k}") for k in range(LANES)])
    fields = sums.select(*keys, "_k", F.array("_n", *[f"_s{k}" for k in range(LANES)]).alias("fields"))
    # in this order come a text, its edited form, the next text
    turn = Window.partitionBy("_b").orderBy("_i", "_k")
    handed = fields.select(*keys, "_k", "fields", F.lead("fields", 1).over(turn).alias("edited_fields"), F.lead("fields", 2).over(turn).alias("next_fields"))
    return handed.filter("_g = 0 and _k = 0").select("doc_id", "n_chars", "edited_sha256", "fields", "edited_fields", "next_fields")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = compared(docs, min(10_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.select("doc_id", "n_chars", "edited_sha256", written_form(F.col("fields")).alias("fingerprint"), written_form(F.col("edited_fields")).alias("edited_fingerprint"), near(F.col("fields"), F.col("edited_fields")).alias("near_edited"), near(F.col("fields"), F.col("next_fields")).alias("near_next"))


OP2_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id nulls first, md5(coalesce(text, ''))) as r, count(*) over () as total from documents),
n as (select a.r, a.doc_id, a.text, length(a.text) as n_chars, b.text as next_text
      from d a join d b on b.r = case when a.r = a.total then 1 else a.r + 1 end),
e as (select *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) as edited from n),
t as (select r, 0 as w, text as x from e union all select r, 1, edited from e union all select r, 2, next_text from e),
p as (select r, w, 'p' || p as u from (select r, w, unnest(string_split(x, chr(10))) as p from t) where p <> ''
      union all select r, w, 's' || unnest(regexp_extract_all(x, '{SENTENCE}', 0)) from t),
u as (select r, w, sha256('0' || u) || sha256('1' || u) || sha256('2' || u) || sha256('3' || u) as h from p),
l as (select r, w, i as lane, sum(('0x' || substr(h, 4 * i - 3, 4))::bigint)::bigint as s, count(*)::bigint as c
      from u, range(1, {LANES + 1}) as g(i) group by r, w, i),
z as (select t.r, t.w, g.i as lane, coalesce(l.s, 0) as s, coalesce(l.c, 0) as c, (2 * coalesce(l.s, 0) - {LANE_MAX} * coalesce(l.c, 0))::double as v
      from t cross join range(1, {LANES + 1}) as g(i) left join l on l.r = t.r and l.w = t.w and l.lane = g.i),
f as (select r, w, printf('%012x', any_value(c)) || string_agg(printf('%012x', s), '' order by lane) as fp from z group by r, w),
s as (select a.r, b.w, sum(a.v * b.v) as ab, sum(a.v * a.v + b.v * b.v) as norm
      from z a join z b on a.r = b.r and a.lane = b.lane where a.w = 0 group by a.r, b.w),
k as (select s.r, s.w, case when fa.fp = fb.fp then 1.0::double when norm = 0 then 0.0::double else round(least(1.0, greatest(0.0, ab * 2 / norm)), 6) end as near
      from s join f fa on fa.r = s.r and fa.w = 0 join f fb on fb.r = s.r and fb.w = s.w)
select e.doc_id, e.n_chars::bigint as n_chars, sha256(e.edited) as edited_sha256, f0.fp as fingerprint, f1.fp as edited_fingerprint,
       k1.near::double as near_edited, k2.near::double as near_next
from e join f f0 on f0.r = e.r and f0.w = 0 join f f1 on f1.r = e.r and f1.w = 1
       join k k1 on k1.r = e.r and k1.w = 1 join k k2 on k2.r = e.r and k2.w = 2
"""
