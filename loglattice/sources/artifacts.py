"""Templates, layouts and archives as files."""

from __future__ import annotations

import bz2
import io
import json
import lzma
import re
import tarfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.text import TOKEN, WILDCARD
from loglattice.operators.templates import MAX_TEMPLATES

TEMPLATES = "eid int, tokens array<string>, n_tokens int, slots array<int>, support long, text string"


def template_text(rows: list[tuple[int, str]]) -> str:
    """The text form: a template's lines, then its id in brackets."""
    return "".join(f"{text}\n[{eid}]\n" for eid, text in rows)


def parse_templates(text: str) -> list[tuple[int, str]]:
    """(id, template) of the text form; templates of several lines keep their line ends. More than MAX_TEMPLATES are refused."""
    out, held = [], []
    for line in text.split("\n"):
        closing = re.fullmatch(r"\[(\d+)\]", line)
        if closing and held:
            out.append((int(closing[1]), "\n".join(held)))
            held = []
        elif line or held:
            held.append(line)
    if len(out) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return out


def tokens_of(text: str) -> list[str]:
    """Tokens of a template: wildcards stand alone, the rest as in matching."""
    return [t for part in re.split(f"({re.escape(WILDCARD)})", text) for t in ([part] if part == WILDCARD else re.findall(TOKEN, part))]


def write_templates(templates: DataFrame, path: str) -> None:
    """One text file of at most MAX_TEMPLATES templates, in order of id; more are refused."""
    rows = [(r.eid, r.text) for r in templates.orderBy("eid").limit(MAX_TEMPLATES + 1).collect()]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = templates.sparkSession
    spark.range(1).select(F.lit(template_text(rows).removesuffix("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for eid, body in parse_templates(text):
        tokens = tokens_of(body)
        rows.append((eid, tokens, len(tokens), [i for i, t in enumerate(tokens) if t == WILDCARD], 1, body))
    return spark.createDataFrame(rows, TEMPLATES)


def write_layout(layout: DataFrame, path: str) -> None:
    """Header layout (one row per field and part) as JSON lines."""
    layout.coalesce(1).write.mode("overwrite").json(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("field int, part int, piece string, length long").json(path)


def write_archive(path: str, encoded: DataFrame, failed: DataFrame, templates: DataFrame) -> None:
    """An archive: encoded columns by block and scope (readers prune both), failed records by block, templates."""
    encoded.repartition("src", "block_id").write.mode("overwrite").option("compression", "uncompressed").partitionBy("block_id", "scope").parquet(f"{path}/columns")
    failed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/failed")
    templates.write.mode("overwrite").parquet(f"{path}/templates")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    encoded = spark.read.schema("eid int, col int, n long, raw_bytes long, meta string, payload binary, src string, block_id long, scope string").parquet(f"{path}/columns")
    return encoded.select("src", "block_id", "scope", "eid", "col", "n", "raw_bytes", "meta", "payload"), spark.read.parquet(f"{path}/failed"), spark.read.schema(TEMPLATES).parquet(f"{path}/templates")


def column_metas(encoded: DataFrame) -> DataFrame:
    """(src, block_id, scope, eid, col, kind, pattern, kernel): what each column's JSON says."""
    m = F.from_json("meta", "kind string, pattern string, kernel string")
    return encoded.select("src", "block_id", "scope", "eid", "col", m.alias("m")).select("src", "block_id", "scope", "eid", "col", "m.*")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(src, member, content) of .gz, .bz2, .xz files and of tar archives packed by one of them."""

    def unpack(batches):
        for pdf in batches:
            out = []
            for src, raw in zip(pdf.path, pdf.content):
                data = bytes(raw)
                if re.search(r"\.(gz|tgz)$", src):
                    data = zlib.decompress(data, 47)
                elif src.endswith(".bz2"):
                    data = bz2.decompress(data)
                elif src.endswith((".xz", ".lzma")):
                    data = lzma.decompress(data)
                if re.search(r"\.tar(\.|$)|\.tgz$", src):
                    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                        out += [(src, m.name, tar.extractfile(m).read()) for m in tar if m.isfile()]
                else:
                    out.append((src, "", data))
            yield pd.DataFrame(out, columns=["src", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "src string, member string, content binary")


def write_results(results: DataFrame, path: str) -> None:
    """A small results table as one CSV file."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def layout_json(rows: list) -> str:
    return json.dumps([r.asDict() for r in rows], sort_keys=True)
