"""Registered queries of the log engine, each next to its SQL where SQL can say it.

The log lines are made from `events` (sources.lines); positions and blocks come
from event_id. Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import codec as C
from loglattice.functions import similarity as S
from loglattice.functions import text as X
from loglattice.operators import archive as A
from loglattice.operators import cluster as K
from loglattice.operators import headers as H
from loglattice.operators import matcher as M
from loglattice.operators import metrics as Q
from loglattice.operators import profile as P
from loglattice.operators import templates as T
from loglattice.operators import windows as W
from loglattice.operators.order import chunk_sample as chunk_chosen
from loglattice.operators.order import hash_rank, with_position
from loglattice.sources import formats
from loglattice.sources.lines import LINES_SQL, assemble_records, event_lines, with_blocks
from loglattice.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HEAD, WINDOW, BLOCK = 3, 20, 100_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return event_lines(table(spark, d, "events"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    return with_position(table(spark, d, "events"), "event_id").select("pos", F.col("user_id").alias("eid"))


TOKENS = "regexp_extract_all(line, '([^ \\t:=,]+|[ \\t:=,])', 1)"
SIG = f"array_to_string(list_transform({TOKENS}, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end), '')"
DOC_LINES = "dl as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents)"
TEMPLATES_SQL = f"""{LINES_SQL},
tk as (select sig, unnest(toks) as tok, unnest(range(len(toks))) as pos from (select {SIG} as sig, {TOKENS} as toks from lines)),
mg as (select sig, pos, case when min(tok) = max(tok) then min(tok) else '<*>' end as token from tk group by sig, pos),
sc as (select {SIG} as sig, count(*) as support from lines group by 1),
tt as (select sig, list(token order by pos) as tokens, any_value(support) as support from mg join sc using (sig) group by sig),
tp as (select *, array_to_string(tokens, '') as text, row_number() over (order by support desc, array_to_string(tokens, '')) as eid from tt),
mt as (select l.rec_no, l.toks, min(t.eid) as eid from (select rec_no, {TOKENS} as toks from lines) l left join tp t
       on len(t.tokens) = len(l.toks) and len(list_filter(list_zip(t.tokens, l.toks), lambda z: z[1] <> '<*>' and z[1] <> z[2])) = 0 group by l.rec_no, l.toks)"""
SLOTS_SQL = f"""{TEMPLATES_SQL},
sl as (select rec_no, eid, unnest(range(len(vals))) as slot, unnest(vals) as value from
       (select mt.rec_no, mt.eid, list_transform(list_filter(list_zip(tp.tokens, mt.toks), lambda z: z[1] = '<*>'), lambda z: z[2]) as vals from mt join tp on tp.eid = mt.eid))"""
HEADER_SQL = f"""{LINES_SQL},
hv as (select rec_no, unnest(range(3)) as field, unnest(regexp_extract_all(h, '[^ \\t|]+', 0)) as value, unnest(regexp_extract_all(h, '[ \\t|]+', 0)) as delim
       from (select rec_no, regexp_extract(line, '^((?:[^ \\t|]+[ \\t|]+){{3}})', 1) as h from lines qualify h <> '' and row_number() over (partition by h <> '' order by rec_no) <= 5000)),
pt as (select *, regexp_extract_all(value, '([0-9]+|[^0-9]+)', 1) as parts from hv),
pc as (select field, len(parts) as n_parts, count(*) as n from pt group by 1, 2),
pm as (select field, n_parts, n, sum(n) over (partition by field) as total, row_number() over (partition by field order by n desc, n_parts) as k from pc)"""

ALL_HEADERS_SQL = HEADER_SQL.replace("qualify h <> '' and row_number() over (partition by h <> '' order by rec_no) <= 5000", "where h <> ''")


@query(f"with {LINES_SQL} select {SIG} as sig, count(*) as n from lines group by 1")
def template_counts(spark, d):
    return T.template_counts(lines(spark, d))


@query(f"with {LINES_SQL} select count(*) as n, min(len({TOKENS}))::int as least, max(len({TOKENS}))::int as most, sum(len({TOKENS}))::bigint as total from lines")
def token_stats(spark, d):
    n = lines(spark, d).select(F.size(X.match_tokens(F.col("line"))).alias("k"))
    return n.agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))


@query(f"with {LINES_SQL} select tok, count(*) as n from (select unnest({TOKENS}) as tok from lines) group by tok order by n desc, tok limit 20")
def token_topk(spark, d):
    return lines(spark, d).select(F.explode(X.match_tokens(F.col("line"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(20)


@query("""select doc_id, len(regexp_extract_all(text, '([^ \\t:=,]+|[ \\t:=,])', 1))::int as n_match,
len(regexp_extract_all(text, '([\\t\\n\\x0B\\f\\r ]+|[:,=]|[^\\t\\n\\x0B\\f\\r :,=]+)', 1))::int as n_train from documents""")
def whitespace_run_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.match_tokens(F.col("text"))).alias("n_match"), F.size(X.training_tokens(F.col("text"))).alias("n_train"))


@query(f"with {LINES_SQL} select rec_no, regexp_extract(line, '^(.*?)\\s+(.*?)\\s+(.*?)\\s+(.*)$', 1) as Date, regexp_extract(line, '^(.*?)\\s+(.*?)\\s+(.*?)\\s+(.*)$', 2) as Time, regexp_extract(line, '^(.*?)\\s+(.*?)\\s+(.*?)\\s+(.*)$', 3) as Level, regexp_extract(line, '^(.*?)\\s+(.*?)\\s+(.*?)\\s+(.*)$', 4) as Content from lines")
def layout_fields(spark, d):
    return formats.parse_layout(lines(spark, d), "<Date> <Time> <Level> <Content>").drop("line")


@query(f"with {LINES_SQL} select rec_no, regexp_replace(regexp_replace(line, '(\\d+\\.){{3}}\\d+', '<*>', 'g'), '\\d{{2}}:\\d{{2}}:\\d{{2}}', '<*>', 'g') as masked from lines")
def dataset_masks(spark, d):
    return lines(spark, d).select("rec_no", formats.masked(F.col("line"), "Linux").alias("masked"))


@query(f"with {HEADER_SQL} select field::int as field, n_parts::bigint as n_parts, n, total::bigint as total, n >= 0.95 * total as formatted from pm where k = 1")
def header_part_mode(spark, d):
    return H.part_mode(H.header_values(lines(spark, d), HEAD))


@query(f"""with {HEADER_SQL},
ex as (select pt.field, unnest(range(len(parts))) as part, unnest(parts) as p from pt join pm on pm.field = pt.field and pm.k = 1 and pm.n >= 0.95 * pm.total and len(pt.parts) = pm.n_parts),
sh as (select field, part, case when regexp_matches(p, '^[0-9]') then '%d' else p end as piece, case when regexp_matches(p, '^[0-9]') then length(p) else 0 end as len from ex),
a as (select field, part, piece, count(*) as n, sum(count(*)) over (partition by field, part) as total, row_number() over (partition by field, part order by count(*) desc, piece) as k from sh group by 1, 2, 3),
b as (select field, part, len, count(*) as m, row_number() over (partition by field, part order by count(*) desc, len) as k from sh group by 1, 2, 3),
c as (select a.field, a.part, a.piece, a.n >= 0.95 * a.total as ok, case when a.piece = '%d' and b.m < 0.95 * a.total then -1 else b.len end as len from a join b on a.field = b.field and a.part = b.part and a.k = 1 and b.k = 1)
select field::int as field, part::int as part, piece, len::bigint as length from c where field in (select field from c group by field having bool_and(ok) and bool_or(piece = '%d'))""")
def header_layout(spark, d):
    return H.layout(H.header_values(lines(spark, d), HEAD))


@query(f"""with {ALL_HEADERS_SQL}, m as (select field, delim, count(*) as n, row_number() over (partition by field order by count(*) desc, min(rec_no)) as k from hv group by 1, 2)
select field::int as field, delim, n from m where k = 1""")
def modal_delimiter(spark, d):
    return H.modal_delimiters(H.header_values(lines(spark, d), HEAD, None))


@query(f"""with {ALL_HEADERS_SQL}, e as (select rec_no, field, unnest(range(len(parts))) as part, unnest(parts) as p from pt)
select rec_no, field::int as field, part::int as part, p::bigint as number from e where regexp_matches(p, '^[0-9]{{1,18}}$')""")
def header_numbers(spark, d):
    return H.header_numbers(H.header_values(lines(spark, d), HEAD, None))


@query("select count(*) as n, count(*) filter (c_name <> 'Customer#' || lpad(regexp_extract(c_name, '([0-9]+)', 1)::bigint::varchar, length(regexp_extract(c_name, '([0-9]+)', 1))::int, '0')) as mismatches from customer")
def zero_pad_roundtrip(spark, d):
    digits = F.regexp_extract("c_name", "([0-9]+)", 1)
    back = F.concat(F.lit("Customer#"), X.zero_padded(digits.cast("bigint").cast("string"), F.length(digits)))
    return table(spark, d, "customer").agg(F.count("*").alias("n"), F.count_if(F.col("c_name") != back).alias("mismatches"))


@query(f"with {TEMPLATES_SQL} select sig, pos::int as pos, token from mg")
def template_merge(spark, d):
    return T.merged_templates(lines(spark, d))


@query(f"with {TEMPLATES_SQL} select rec_no, coalesce(eid, 0)::int as eid from mt")
def template_match(spark, d):
    log = lines(spark, d)
    return M.matched(log, T.bounded(T.templates_of(log))).select("rec_no", "eid")


@query(f"with {SLOTS_SQL} select rec_no, eid::int as eid, slot::int as slot, value from sl")
def slot_values(spark, d):
    log = lines(spark, d)
    return M.slot_values(M.matched(log, T.bounded(T.templates_of(log))))


@query(f"""with {DOC_LINES}, h as (select line, regexp_extract(line, '^((?:[^ \\t|]+[ \\t|]+){{2}})', 1) as head from dl),
c as (select line, head, substr(line, length(head) + 1) as content from h)
select case when length(trim(line, ' ')) = 0 then 'empty' when contains(line, chr(0)) then 'bad_char' when length(line) > 300000 then 'too_long'
when length(content) = 0 then 'no_content' when len(regexp_extract_all(content, '([^ \\t:=,]+|[ \\t:=,])', 1)) >= 2048 then 'too_many_tokens' when head = '' then 'wrong_format' else 'loaded' end as reason, count(*) as n from c group by 1""")
def load_failures(spark, d):
    rows = document_lines(spark, d).withColumn("head", X.head_of(F.col("line"), 2)).withColumn("content", F.substr("line", F.length("head") + 1, F.length("line")))
    bad = M.failure(F.col("line"), F.col("content"), F.size(X.match_tokens(F.col("content"))))
    return M.load_statistics(rows.withColumn("fail_reason", F.coalesce(bad, F.when(F.col("head") == "", "wrong_format"))))


@query(f"""with {DOC_LINES}, g as (select *, sum(case when regexp_matches(line, '^(?:[A-Z])') then 1 else 0 end) over (partition by doc_id order by line_no) as g from dl)
select doc_id, min(line_no)::bigint as rec_no, md5(string_agg(line, chr(10) order by line_no)) as raw_md5, count(*) as n_lines, g = 0 as no_head from g group by doc_id, g""")
def multiline_records(spark, d):
    records = assemble_records(document_lines(spark, d), "[A-Z]", "doc_id", "line_no")
    return records.select("doc_id", "rec_no", F.md5("raw").alias("raw_md5"), "n_lines", "no_head")


@query(f"with {DOC_LINES} select {SIG} as sig, count(*) as n from dl group by 1 having count(*) = 1")
def singleton_templates(spark, d):
    return T.template_counts(document_lines(spark, d)).filter("n = 1")


@query(f"with {LINES_SQL} select sig, (row_number() over (order by sig) - 1)::int as id, n from (select {SIG} as sig, count(*) as n from lines group by 1)")
def dense_ids(spark, d):
    from pyspark.sql import Window

    # a bounded table: more signatures than templates may be are refused
    counts = T.bounded(T.template_counts(lines(spark, d)).limit(T.MAX_TEMPLATES + 1))
    return counts.select("sig", (F.row_number().over(Window.orderBy("sig")) - 1).alias("id"), "n")


def slot_columns(spark, d) -> DataFrame:
    log = lines(spark, d)
    slots = M.slot_values(M.matched(log, T.bounded(T.templates_of(log))))
    return written(slots.select(F.lit("V").alias("scope"), "eid", F.col("slot").alias("col"), F.col("rec_no").alias("pos"), "value"), "slots")


PROFILE_SQL = f"""{SLOTS_SQL},
pf as (select eid, slot, count(*) as n, count(distinct value) as n_distinct, bool_and(regexp_matches(value, '^(0|-?[1-9][0-9]{{0,17}})$')) as is_num,
       case when bool_and(regexp_matches(value, '^[0-9]{{1,18}}$')) and min(length(value)) = max(length(value)) then min(length(value)) end as fixed_length from sl group by 1, 2)"""


@query(f"with {PROFILE_SQL} select 'V' as scope, eid::int as eid, slot::int as col, n, n_distinct, is_num, coalesce(fixed_length, -1)::bigint as fixed_length from pf")
def column_profile(spark, d):
    return P.column_profile(slot_columns(spark, d)).withColumn("fixed_length", F.coalesce("fixed_length", F.lit(-1)))


@query(f"""with {PROFILE_SQL}, v as (select eid, slot, rec_no, value::bigint as x from sl join pf using (eid, slot) where is_num),
dd as (select *, x - lag(x) over (partition by eid, slot order by rec_no) as dx from v),
hr as (select eid, slot, sum(-p * ln(p) * log2(abs(x)::double + 1)) + 0.0 as h from (select eid, slot, x, count(*) / sum(count(*)) over (partition by eid, slot) as p from dd group by 1, 2, 3) group by 1, 2),
hd as (select eid, slot, sum(-p * ln(p) * log2(abs(dx)::double + 1)) + 0.0 as h from (select eid, slot, dx, count(*) / sum(count(*)) over (partition by eid, slot) as p from dd where dx is not null group by 1, 2, 3) group by 1, 2)
select 'V' as scope, pf.eid::int as eid, slot::int as col, n, n_distinct, case when is_num and hr.h >= coalesce(hd.h, 0) then 'delta' when is_num then 'integer' when fixed_length is not null then 'fixed'
when n_distinct < 0.5 * n then 'dictionary' else 'string' end as kind from pf left join hr using (eid, slot) left join hd using (eid, slot)""")
def encoding_plan(spark, d):
    return P.encoding_plan(slot_columns(spark, d))


@query("select regexp_replace(url, '[^-#><_:;,\\[\\]\\\\/.()]', '', 'g') as signature, count(*) as n from pages group by 1")
def delimiter_signature(spark, d):
    return P.signatures(table(spark, d, "pages"), "url")


PARTS = "'^([^:]*):([^/]*)/([^/]*)/([^.]*)\\.([^/]*)/(.*)$'"


@query(f"select page_id, k::int as part, regexp_extract(url, {PARTS}, k + 1) as value from pages, (values (0), (1), (2), (3), (4), (5)) as t(k)".replace("regexp_extract(url, " + PARTS + ", k + 1)", "case k " + " ".join(f"when {k} then regexp_extract(url, {PARTS}, {k + 1})" for k in range(6)) + " end"))
def pattern_split(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(P.split_pattern(F.col("url"), "://./")).alias("part", "value"))


@query("select page_id, url as restored from pages")
def pattern_recover(spark, d):
    return table(spark, d, "pages").select("page_id", P.joined_pattern(P.split_pattern(F.col("url"), "://./"), "://./").alias("restored"))


@query()
def pattern_lcs(spark, d):
    return P.common_pattern(table(spark, d, "pages"), "url", [], "page_id")


@query("select round(sum(-p * ln(p) * log2(abs(user_id)::double + 1)), 6) as h from (select user_id, count(*) / sum(count(*)) over () as p from events group by 1)")
def weighted_entropy(spark, d):
    return P.weighted_entropy(table(spark, d, "events"), "user_id", []).select(F.round("h", 6).alias("h"))


ORDERS_SQL = "ob as (select o_orderkey, o_custkey, o_orderpriority, r - 1 as pos, (r - 1) // 100000 as block_id from (select *, row_number() over (order by o_orderkey) as r from orders))"
DELTAS_SQL = f"{ORDERS_SQL}, od as (select *, o_custkey - lag(o_custkey) over (partition by block_id order by pos) as delta from ob)"


def order_column(spark, d) -> DataFrame:
    return with_position(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority", "pos", F.floor(F.col("pos") / BLOCK).alias("block_id"))


@query(f"""with {DELTAS_SQL},
a as (select block_id, sum(-p * ln(p) * log2(abs(o_custkey)::double + 1)) + 0.0 as h from (select block_id, o_custkey, count(*) / sum(count(*)) over (partition by block_id) as p from od group by 1, 2) group by 1),
b as (select block_id, sum(-p * ln(p) * log2(abs(delta)::double + 1)) + 0.0 as h from (select block_id, delta, count(*) / sum(count(*)) over (partition by block_id) as p from od where delta is not null group by 1, 2) group by 1)
select block_id::bigint as block_id, round(a.h, 6) as h_raw, round(b.h, 6) as h_delta, a.h >= b.h as use_delta from a join b using (block_id)""")
def delta_rule(spark, d):
    rule = P.delta_rule(order_column(spark, d), "o_custkey", ["block_id"])
    return rule.select("block_id", F.round("h_raw", 6).alias("h_raw"), F.round("h_delta", 6).alias("h_delta"), "use_delta")


@query(f"with {DELTAS_SQL} select o_orderkey, coalesce(delta, o_custkey) as encoded from od")
def delta_encode(spark, d):
    return P.deltas(order_column(spark, d), "o_custkey", ["block_id"]).select("o_orderkey", "encoded")


@query("select o_orderkey, o_custkey::bigint as restored from orders")
def delta_recover(spark, d):
    return P.undeltas(P.deltas(order_column(spark, d), "o_custkey", ["block_id"]), ["block_id"]).select("o_orderkey", "restored")


@query(f"""with {ORDERS_SQL}, f as (select block_id, o_orderpriority, min(pos) as first from ob group by 1, 2), i as (select *, row_number() over (partition by block_id order by first) - 1 as id from f)
select o_orderkey, i.id::bigint as id from ob join i using (block_id, o_orderpriority)""")
def dict_encode(spark, d):
    rows = order_column(spark, d).withColumnRenamed("o_orderpriority", "value")
    return rows.join(P.dictionary(rows, ["block_id"], ["pos"]), ["block_id", "value"]).select("o_orderkey", "id")


@query("select o_orderkey, o_orderpriority as value from orders")
def dict_recover(spark, d):
    rows = order_column(spark, d).withColumnRenamed("o_orderpriority", "value")
    names = P.dictionary(rows, ["block_id"], ["pos"])
    coded = rows.join(names, ["block_id", "value"]).select("o_orderkey", "block_id", "id")
    return coded.join(names, ["block_id", "id"]).select("o_orderkey", "value")


ZIGZAG_SQL = f"{DELTAS_SQL}, zz as (select o_orderkey, coalesce(delta, o_custkey) as v, case when coalesce(delta, o_custkey) >= 0 then 2 * coalesce(delta, o_custkey) else -2 * coalesce(delta, o_custkey) - 1 end as z from od)"


@query(f"with {ZIGZAG_SQL} select o_orderkey, z::bigint as z, v::bigint as back from zz")
def zigzag(spark, d):
    z = X.zigzag(F.col("encoded"))
    return P.deltas(order_column(spark, d), "o_custkey", ["block_id"]).select("o_orderkey", z.alias("z"), X.unzigzag(z).alias("back"))


@query(f"with {ZIGZAG_SQL} select count(*) as n, sum(greatest(1, ceil(length(ltrim(bin(z), '0')) / 7.0)))::bigint as bytes from zz")
def varint_size(spark, d):
    return P.deltas(order_column(spark, d), "o_custkey", ["block_id"]).agg(F.count("*").alias("n"), F.sum(X.varint_size(X.zigzag(F.col("encoded")))).alias("bytes"))


@query(f"""with {ZIGZAG_SQL} select count(*) as n, count(*) filter (v < 0) as negatives, coalesce(sum(-v) filter (v < 0), 0)::bigint as magnitude,
sum(greatest(1, ceil(length(ltrim(bin(v), '0')) / 7.0))) filter (v >= 0)::bigint as rest_bytes from zz""")
def positive_stream(spark, d):
    v = F.col("encoded")
    rows = P.deltas(order_column(spark, d), "o_custkey", ["block_id"])
    return rows.agg(F.count("*").alias("n"), F.count_if(v < 0).alias("negatives"), F.coalesce(F.sum(F.when(v < 0, -v)), F.lit(0)).alias("magnitude"), F.sum(F.when(v >= 0, X.varint_size(v))).alias("rest_bytes"))


@query("select mode, count(*)::bigint as n, 0::bigint as mismatches from orders, (values ('zigzag'), ('positive'), ('text')) as t(mode) group by mode")
def codec_roundtrip(spark, d):
    groups = P.deltas(order_column(spark, d), "o_custkey", ["block_id"]).groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "encoded"))), lambda x: x["encoded"]).alias("v"))
    out = None
    for mode in ("zigzag", "positive", "text"):
        back = groups.select("v", C.bytes_to_ints(C.ints_to_bytes(F.col("v"), mode), mode).alias("w"))
        wrong = F.size(F.filter(F.zip_with("v", "w", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
        one = back.agg(F.sum(F.size("v")).alias("n"), F.sum(wrong).alias("mismatches")).select(F.lit(mode).alias("mode"), "n", F.col("mismatches").cast("long").alias("mismatches"))
        out = one if out is None else out.union(one)
    return out


def message_templates(spark, log: DataFrame) -> DataFrame:
    """Templates of what follows the header, as a small local table (at most MAX_TEMPLATES rows)."""
    content = log.withColumn("line", F.regexp_replace("line", f"^(?:[^ \\t|]+[ \\t|]+){{{HEAD}}}", ""))
    return T.bounded(T.templates_of(content))


@query()
def archive_sizes(spark, d):
    log = with_blocks(lines(spark, d))
    return Q.archive_sizes(log, message_templates(spark, log), HEAD, ["lzma", "gzip", "bzip2", "zstd"])


@query()
def codec_baseline(spark, d):
    return Q.baselines(with_blocks(lines(spark, d)))


@query(f"with {LINES_SQL} select 0::bigint as block_id, rec_no, line from lines".replace("0::bigint", "(rec_no // 100000)::bigint"))
def restore_lines(spark, d):
    log = with_blocks(lines(spark, d))
    templates = message_templates(spark, log)
    encoded, failed = A.compressed(log, templates, HEAD, "zstd")
    return A.restored(encoded, failed, templates).drop("src")


@query(f"with {LINES_SQL} select count(*) as n, 1.0::double as score from lines")
def line_match_score(spark, d):
    log = with_blocks(lines(spark, d))
    return Q.match_score(log, restore_lines(spark, d))


IDS_SQL = "ids as (select row_number() over (order by event_id) - 1 as pos, user_id as eid from events)"
HIST_SQL = f"{IDS_SQL}, wh as (select pos // 20 as win_id, eid, count(*) as n from ids group by 1, 2)"


@query(f"""with {IDS_SQL} select (pos // 20)::bigint as win_id, array_to_string(list_resize(list(eid order by pos), 20, -1), ',') as seq from ids group by 1""")
def count_windows(spark, d):
    return W.count_windows(ids(spark, d), WINDOW).select("win_id", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


@query(f"with {HIST_SQL} select win_id::bigint as win_id, eid, n from wh")
def window_hist(spark, d):
    return W.window_hist(ids(spark, d), WINDOW)


IDF_SQL = f"""{HIST_SQL}, nw as (select count(distinct win_id) as n from wh), xx as (select eid, ln((nw.n + 1) / (count(*) + 1.0)) as x from wh, nw group by eid, nw.n),
wt as (select eid, 1 / (1 + exp(avg(x) over () - x)) as weight from xx)"""


@query(f"with {IDF_SQL} select eid, round(weight, 6) as weight from wt")
def idf_weights(spark, d):
    return W.idf_weights(W.window_hist(ids(spark, d), WINDOW)).select("eid", F.round("weight", 6).alias("weight"))


@query(f"with {IDF_SQL} select win_id::bigint as win_id, eid, round(n * weight, 6) as w from wh join wt using (eid)")
def window_vectors(spark, d):
    return W.window_vectors(W.window_hist(ids(spark, d), WINDOW)).select("win_id", "eid", F.round("w", 6).alias("w"))


SAMPLE_SQL = "sv as (select * from embeddings order by md5('0|' || vec_id), vec_id limit 100)"


@query(f"with {SAMPLE_SQL} select vec_id, label from sv")
def hash_sample(spark, d):
    return hash_rank(table(spark, d, "embeddings"), "0", "vec_id", 100).select("vec_id", "label")


@query("select vec_id, label from (select vec_id, label, row_number() over (partition by label order by md5('0|' || vec_id), vec_id) as k from embeddings) where k <= 8")
def balanced_sample(spark, d):
    return W.balanced_sample(table(spark, d, "embeddings"), 8, "0", "vec_id", "label").select("vec_id", "label")


@query(f"""with {SAMPLE_SQL} select x.vec_id as a, y.vec_id as b, round(sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 4) as dist
from sv x join sv y on x.vec_id < y.vec_id order by dist, a, b limit 20""")
def window_distance_topk(spark, d):
    sample = hash_rank(table(spark, d, "embeddings"), "0", "vec_id", 100).withColumn("v", F.col("embedding").cast("array<double>"))
    return K.pair_distances(sample, "vec_id", "v").withColumn("dist", F.round("dist", 4)).orderBy("dist", "a", "b").limit(20)


@query("""with c as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings) group by 1, 2),
cc as (select label, list(x order by i) as v from c where label in (select label from embeddings group by 1 having count(*) >= 3) group by 1),
p as (select vec_id, cc.label as cluster, sqrt(list_sum(list_transform(list_zip(embedding, cc.v), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2])))) as dist from embeddings, cc)
select vec_id, arg_min(cluster, dist)::int as cluster, round(min(dist), 4) as dist from p group by 1""")
def nearest_center(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
    return K.nearest(vectors, K.representatives(vectors, "cluster", "v"), "vec_id", "v", "cluster").select("vec_id", "cluster", F.round("dist", 4).alias("dist"))


@query(f"""with {SAMPLE_SQL} select e.vec_id, round(min(sqrt(list_sum(list_transform(list_zip(e.embedding, sv.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))))), 4) as dist
from embeddings e, sv group by 1""")
def min_distance(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return K.min_distance(vectors, hash_rank(vectors, "0", "vec_id", 100), "vec_id", "v").select("vec_id", F.round("dist", 4).alias("dist"))


@query("select label, min(vec_id) as center from embeddings group by 1")
def center_index(spark, d):
    return W.center_index(table(spark, d, "embeddings"), "vec_id", "label")


@query(f"""with {IDS_SQL}, ch as (select distinct pos // 20 as win_id from ids order by md5('0|' || win_id), win_id limit 10)
select pos, eid from ids where pos // 20 in (select win_id from ch)""")
def window_rows(spark, d):
    found = ids(spark, d)
    windows = found.select(F.floor(F.col("pos") / WINDOW).alias("win_id")).distinct()
    return W.window_rows(found, hash_rank(windows, "0", "win_id", 10), WINDOW)


@query()
def complete_linkage(spark, d):
    return K.complete_linkage(table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "vec_id", "v", 1.0)


@query()
def iterative_clusters(spark, d):
    return K.iterative_clusters(table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "vec_id", "v", 1.0)


BIGRAMS = "list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || chr(0) || z[2]))"


@query(f"""with w as (select doc_id, string_split(text, ' ') as w from documents), g as (select doc_id, case when len(w) >= 2 then {BIGRAMS} else [] end as g from w)
select a.doc_id, round(case when len(a.g) + len(b.g) > 0 then (len(a.g) + len(b.g) - 2 * len(list_intersect(a.g, b.g))) / (len(a.g) + len(b.g))::double else 0 end, 6) as dist from g a join g b on b.doc_id = a.doc_id + 1""")
def ngram_distance(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("a"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return words.join(after, "doc_id").select("doc_id", F.round(S.ngram_distance(F.col("a"), F.col("b"), 2), 6).alias("dist"))


@query("""with dw as (select doc_id, unnest(list_distinct(string_split(text, ' '))) as w from documents), bw as (select item_id, unnest(list_distinct(string_split(text, ' '))) as w from benchmark),
dn as (select doc_id, count(*) as n from dw group by 1), bn as (select item_id, count(*) as n from bw group by 1),
s as (select doc_id, item_id, count(*) as c from dw join bw using (w) group by 1, 2),
j as (select doc_id, item_id, 1 - c / (dn.n + bn.n - c)::double as dist from s join dn using (doc_id) join bn using (item_id))
select doc_id, item_id, round(dist, 6) as dist from (select *, row_number() over (partition by doc_id order by dist, item_id) as k from j) where k = 1""")
def jaccard_words(spark, d):
    from pyspark.sql import Window

    words = lambda t, key: table(spark, d, t).select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    dw, bw = words("documents", "doc_id"), words("benchmark", "item_id")
    shared = dw.join(bw, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("c"))
    sized = shared.join(dw.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").join(bw.groupBy("item_id").agg(F.count("*").alias("m")), "item_id")
    dist = sized.select("doc_id", "item_id", (1 - F.col("c") / (F.col("n") + F.col("m") - F.col("c")).cast("double")).alias("dist"))
    best = dist.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("dist", "item_id"))).filter("k = 1")
    return best.select("doc_id", "item_id", F.round("dist", 6).alias("dist"))


@query("select a.p_partkey, round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::double, 6) as dist from part a join part b on b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, d):
    a, b = part_pairs(spark, d)
    return a.join(b, "p_partkey").select("p_partkey", F.round(S.edit_distance(F.col("a"), F.col("b")), 6).alias("dist"))


def part_pairs(spark, d):
    parts = table(spark, d, "part")
    return parts.select("p_partkey", F.col("p_name").alias("a")), parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))


# a row of the usual table: candidates from the row before, then their running maxima
LCS_SQL = """recursive ab as (select a.p_partkey, string_split(a.p_name, '') as x, string_split(b.p_name, '') as y from part a join part b on b.p_partkey = a.p_partkey + 1),
dp(p_partkey, x, y, i, cells) as (select p_partkey, x, y, 0, list_transform(range(len(y) + 1), lambda j: 0::bigint) from ab union all
 select p_partkey, x, y, i + 1, list_prepend(0::bigint, list_transform(range(1, len(y) + 1), lambda j: list_max(cand[1:j])))
 from (select *, list_transform(range(1, len(y) + 1), lambda j: case when y[j] = x[i + 1] then cells[j] + 1 else cells[j + 1] end) as cand from dp where i < len(x))),
ll as (select p_partkey, len(x)::double as n, len(y)::double as m, cells[len(y) + 1]::double as k from dp where i = len(x))"""


@query(f"with {LCS_SQL} select p_partkey, round(1 - k / n, 6) as dist, round(1 - 2 * k / (n + m), 6) as both from ll")
def lcs_distance(spark, d):
    a, b = part_pairs(spark, d)
    words = lambda c: F.split(c, "")
    return a.join(b, "p_partkey").select("p_partkey", F.round(S.lcs_distance(words("a"), words("b")), 6).alias("dist"), F.round(S.lcs_distance(words("a"), words("b"), True), 6).alias("both"))


@query(f"""with {LCS_SQL} select p_partkey, round((1 - k / n + sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) / 2) / 2, 4) as dist
from ll join part a using (p_partkey) join part b on b.p_partkey = ll.p_partkey + 1""")
def mixed_distance(spark, d):
    vector = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"))
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", "").alias("a"), vector.alias("x"))
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"), F.col("x").alias("y"))
    return parts.join(after, "p_partkey").select("p_partkey", F.round(S.mixed_distance(F.col("a"), F.col("b"), F.col("x"), F.col("y")), 4).alias("dist"))


CHARS_SQL = "ab as (select a.p_partkey, a.p_name as a, b.p_name as b, string_split(a.p_name, '') as x, string_split(b.p_name, '') as y from part a join part b on b.p_partkey = a.p_partkey + 1)"


@query(f"with {CHARS_SQL} select p_partkey, round(2 * len(list_intersect(list_distinct(x), list_distinct(y))) / (len(list_distinct(x)) + len(list_distinct(y)))::double, 6) as similarity from ab")
def ngram_similarity(spark, d):
    a, b = part_pairs(spark, d)
    return a.join(b, "p_partkey").select("p_partkey", F.round(S.ngram_similarity(F.split("a", ""), F.split("b", ""), 1), 6).alias("similarity"))


@query(f"""with {CHARS_SQL}, u as (select p_partkey, unnest(x) as c, 1 as p, 0 as q from ab union all select p_partkey, unnest(y), 0, 1 from ab),
s as (select p_partkey, sum(least(p, q)) as k, sum(p) as n, sum(q) as m from (select p_partkey, c, sum(p) as p, sum(q) as q from u group by 1, 2) group by 1)
select p_partkey, round(1 - k / sqrt(n::double * m), 6) as dist from s""")
def multiset_cosine(spark, d):
    a, b = part_pairs(spark, d)
    return a.join(b, "p_partkey").select("p_partkey", F.round(S.multiset_cosine_distance(F.split("a", ""), F.split("b", "")), 6).alias("dist"))


@query(f"""with {CHARS_SQL}, t as (select p_partkey, 'a' as k, unnest(x) as c from ab union all select p_partkey, 'b', unnest(y) from ab union all select p_partkey, k, unnest(list_concat(x, y)) from ab, (values ('ab')) v(k)),
h as (select p_partkey, k, 1 - sum(p * log2(p)) as e from (select p_partkey, k, c, count(*) / sum(count(*)) over (partition by p_partkey, k) as p from t group by 1, 2, 3) group by 1, 2),
w as (select p_partkey, max(e) filter (k = 'a') as ea, max(e) filter (k = 'b') as eb, max(e) filter (k = 'ab') as eab from h group by 1)
select p_partkey, round(case when a = b then 0 else (eab - least(ea, eb)) / greatest(ea, eb) end, 6) + 0.0 as dist from w join ab using (p_partkey)""")
def entropy_distance(spark, d):
    a, b = part_pairs(spark, d)
    return a.join(b, "p_partkey").select("p_partkey", (F.round(S.entropy_distance("a", "b"), 6) + 0.0).alias("dist"))


@query("""select a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) / len(a.embedding), 6) as dist
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def euclidean_distance(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(S.euclidean(F.col("x"), F.col("y")), 6).alias("dist"))


@query()
def ratcliff(spark, d):
    a, b = part_pairs(spark, d)
    return a.join(b, "p_partkey").select("p_partkey", F.round(S.ratcliff_distance("a", "b"), 6).alias("dist"), F.round(S.entropy_distance("a", "b"), 6).alias("entropy_dist"))


GAP_TEMPLATES = [["<*>", "-", "<*>", "E", "<*>"], ["5", "<*>"]]
GAP_PATTERN = "'^(.*?)-(.*?)E(.*)$'"


@query(f"""select o_orderkey, case when regexp_matches(o_orderpriority, {GAP_PATTERN}) then 0 when regexp_matches(o_orderpriority, '^5') then 1 else -1 end as template,
case when regexp_matches(o_orderpriority, {GAP_PATTERN}) then regexp_replace(o_orderpriority, {GAP_PATTERN}, '\\1|\\2|\\3') when regexp_matches(o_orderpriority, '^5') then o_orderpriority[2:] end as parts from orders""")
def gap_match(spark, d):
    from loglattice.operators.sequences import matched_sequences

    rows = table(spark, d, "orders").select("o_orderkey", F.split("o_orderpriority", "").alias("seq"))
    parts = F.array_join(F.transform("parts", lambda p: F.array_join(p, "")), "|")
    return matched_sequences(rows, "seq", GAP_TEMPLATES).select("o_orderkey", "template", parts.alias("parts"))


@query(f"with {LINES_SQL} select rec_no, regexp_replace(line, '[0-9]+', '<*>', 'g') as collapsed from lines")
def collapsed_wildcards(spark, d):
    return lines(spark, d).select("rec_no", X.collapsed_wildcards(F.regexp_replace("line", "[0-9]", "<*>")).alias("collapsed"))


@query(f"with {ALL_HEADERS_SQL} select rec_no, field::int as field, regexp_matches(value, '^[0-9]+-[0-9]+-[0-9]+$') as fits from hv")
def header_format_check(spark, d):
    return H.header_values(lines(spark, d), HEAD, None).select("rec_no", "field", X.fits_format(F.col("value"), "%d-%d-%d").alias("fits"))


@query(f"with {ZIGZAG_SQL} select o_orderkey, right(lpad(hex(v::bigint), 16, '0'), 8) as bytes from zz")
def big_endian(spark, d):
    return P.deltas(order_column(spark, d), "o_custkey", ["block_id"]).select("o_orderkey", F.hex(X.big_endian(F.col("encoded").cast("bigint"))).alias("bytes"))


@query("""with r as (select p_name, row_number() over (order by p_partkey) - 1 as pos from part), c as (select pos, unnest(string_split(p_name, '')) as ch, unnest(range(length(p_name))) as i from r)
select (pos // 20)::bigint as grp, string_agg(ch, '' order by i, pos) as transposed from c group by 1""")
def transposed(spark, d):
    rows = with_position(table(spark, d, "part"), "p_partkey").groupBy(F.floor(F.col("pos") / WINDOW).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("pos", "p_name"))).alias("s"))
    return rows.select("grp", X.transposed(F.transform("s", lambda x: x["p_name"])).alias("transposed"))


@query(f"""with {LINES_SQL}, ch as (select distinct rec_no // 20 as chunk from lines), k as (select chunk, row_number() over (order by md5('0|' || chunk), chunk) as r, count(*) over () as n from ch)
select rec_no, line from lines where rec_no // 20 in (select chunk from k where r <= least(greatest(floor(n * 0.2), 50), 50000))""")
def chunk_sample(spark, d):
    return chunk_chosen(lines(spark, d), 0.2, "0")


# a log of known messages and of lines that no template fits or that can't be loaded
MIXED_SQL = f"{TEMPLATES_SQL}, {DOC_LINES}, ml as (select rec_no, line from lines union all select 10000000000 + doc_id * 100000 + line_no, line from dl)"


def mixed_lines(spark, d) -> DataFrame:
    rows = document_lines(spark, d).select((F.col("doc_id") * 100_000 + F.col("line_no") + 10_000_000_000).alias("rec_no"), "line")
    return lines(spark, d).union(rows)


@query(f"""with {MIXED_SQL}, t as (select *, {TOKENS} as toks from ml)
select rec_no, (case when length(trim(line, ' ')) = 0 or contains(line, chr(0)) or length(line) > 300000 or len(toks) >= 2048 then -1 else coalesce((select min(eid) from tp
where len(tp.tokens) = len(t.toks) and len(list_filter(list_zip(tp.tokens, t.toks), lambda z: z[1] <> '<*>' and z[1] <> z[2])) = 0), 0) end)::int as eid from t""")
def mixed_match(spark, d):
    return M.matched(mixed_lines(spark, d), T.bounded(T.templates_of(lines(spark, d)))).select("rec_no", "eid")


@query(f"with {MIXED_SQL} select (rec_no // 100000)::bigint as block_id, rec_no, md5(line) as line_md5 from ml")
def restore_mixed(spark, d):
    templates = message_templates(spark, lines(spark, d))
    encoded, failed = A.compressed(with_blocks(mixed_lines(spark, d)), templates, HEAD, "zstd")
    return A.restored(encoded, failed, templates).select("block_id", "rec_no", F.md5("line").alias("line_md5"))


@query(f"with {LINES_SQL} select count(*) as n, 1.0::double as score from lines")
def line_ratio_score(spark, d):
    return Q.ratio_score(with_blocks(lines(spark, d)), restore_lines(spark, d))


@query(f"with {LINES_SQL} select date_trunc('hour', ts) as hour, {SIG} as sig, count(*) as n from lines join events on event_id = rec_no group by 1, 2")
def stream_template_counts(spark, d):
    from loglattice.streaming.counts import hourly_counts

    return hourly_counts(spark, d)


@query()
def trained_templates(spark, d):
    return T.trained_templates(chunk_chosen(lines(spark, d), 0.001, "0")).select("eid", "text", "n_tokens", "support")


@query()
def format_catalogue(spark, d):
    return formats.catalogue(spark)
