"""Log lines as tables: files, the synthetic source made from `events`, multi-line records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_LINES = 100_000


def read_lines(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """(src, rec_no, block_id, line), lines in file order, blanks kept.

    UTF-8 files are split and read in parallel: a line's number is its place in
    its file block plus the lines of the blocks before it, from one count per
    block. Other charsets are decoded file by file.
    """
    if charset.lower() not in ("utf-8", "utf8", "us-ascii"):
        text = spark.read.format("binaryFile").load(path).select(F.col("path").alias("src"), F.decode("content", charset).alias("t"))
        text = text.select("src", F.posexplode(F.split(F.regexp_replace("t", "\\r?\\n$", ""), "\\r?\\n")).alias("rec_no", "line"))
        return text.select("src", F.col("rec_no").cast("long").alias("rec_no"), F.floor(F.col("rec_no") / BLOCK_LINES).alias("block_id"), "line")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    counts = raw.groupBy("src", "at").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = Window.partitionBy("src").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("src", "at", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = raw.join(bases, ["src", "at"]).withColumn("rec_no", F.col("base") + F.col("id") - F.col("low"))
    return numbered.select("src", "rec_no", F.floor(F.col("rec_no") / BLOCK_LINES).alias("block_id"), "line")


def event_lines(events: DataFrame) -> DataFrame:
    """(rec_no, line): a log line for every event, of five message kinds."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    cents = F.round(F.col("value") * 100).cast("bigint")
    user = F.col("user_id")
    kinds = {
        "click": F.concat(F.lit("user u"), user, F.lit(" clicked item="), k, F.lit(" at 10.0."), user % 256, F.lit("."), k),
        "view": F.concat(F.lit("page /p/"), k, F.lit("/index viewed by user: u"), user),
        "purchase": F.concat(F.lit("order placed: user="), user, F.lit(", cents="), cents, F.lit(", item="), k),
        "signup": F.concat(F.lit("new account "), user, F.lit(" from ref_"), k),
    }
    text = F.concat(F.lit("failure code="), k, F.lit(": retry "), user % 5, F.lit(" cents "), cents)
    for kind, form in kinds.items():
        text = F.when(F.col("event_type") == kind, form).otherwise(text)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(" "), text)
    return events.select(F.col("event_id").alias("rec_no"), line.alias("line"))


LINES_SQL = """
lines as (select event_id as rec_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' ' ||
  case event_type
    when 'click' then 'user u' || user_id || ' clicked item=' || k || ' at 10.0.' || user_id % 256 || '.' || k
    when 'view' then 'page /p/' || k || '/index viewed by user: u' || user_id
    when 'purchase' then 'order placed: user=' || user_id || ', cents=' || cents || ', item=' || k
    when 'signup' then 'new account ' || user_id || ' from ref_' || k
    else 'failure code=' || k || ': retry ' || user_id % 5 || ' cents ' || cents end as line
  from (select *, regexp_extract(props, '([0-9]+)', 1) as k, cast(round(value * 100) as bigint) as cents from events))"""


def with_blocks(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    return lines.withColumn("block_id", F.floor(F.col("rec_no") / block_lines))


def assemble_records(lines: DataFrame, head_regex: str, by: str = "src", order: str = "rec_no") -> DataFrame:
    """Multi-line records: a line that begins with head_regex opens one, others are appended with line ends.

    (by, rec_no of the head line, raw, n_lines); lines before the first head form
    a record numbered by their first line with no_head true. Windows run per
    source, so sources are assembled in parallel.
    """
    w = Window.partitionBy(by).orderBy(order)
    opened = lines.withColumn("_head", F.col("line").rlike(f"^(?:{head_regex})")).withColumn("_no", F.sum(F.col("_head").cast("int")).over(w))
    grouped = opened.groupBy(by, "_no").agg(F.min(order).alias("rec_no"), F.array_sort(F.collect_list(F.struct(order, "line"))).alias("_l"))
    return grouped.select(by, "rec_no", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("raw"), F.size("_l").cast("long").alias("n_lines"), (F.col("_no") == 0).alias("no_head"))
