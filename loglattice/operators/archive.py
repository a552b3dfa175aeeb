"""Columns to encoded blobs and back, and lines restored exactly.

A block's lines are bounded (100,000) and lie together in one task, as Arrow
tables; its columns are taken from them and analysed and encoded one after the
other, and restoring decodes a block at once and joins its lines by column.
Nothing is shuffled but parsed lines on the way there and encoded columns on
the way back. Kinds: integer, delta, fixed-width digits, dictionary, pattern
(split in parts that are encoded on their own), string.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import text as X
from loglattice.functions.codec import KERNELS, UNPACK, decode_ints, decode_varints, encode_ints, encode_varints
from loglattice.operators.matcher import matched
from loglattice.operators.profile import DISTINCT_SHARE, string_lcs
from loglattice.operators.templates import MAX_TEMPLATES, WILD
from loglattice.sources.scratch import written

LIMIT = 1 << 62

_integer, _digits, _other = re.compile(X.INTEGER), re.compile(X.FIXED_DIGITS), re.compile(X.SIGNATURE_CHARS)


def entropy(values: np.ndarray) -> float:
    found, counts = np.unique(values, return_counts=True)
    share = counts / len(values)
    return -float(np.sum(share * np.log(share) * np.log2(np.abs(found) + 1.0)))


def _blobs(parts: list[bytes]) -> bytes:
    return encode_varints(np.array([len(parts), *map(len, parts)])) + b"".join(parts)


def _unblobs(data: bytes) -> list[bytes]:
    raw = np.frombuffer(data, np.uint8)
    n = int(decode_varints(data[: int(np.flatnonzero(raw < 128)[0]) + 1])[0])
    head = int(np.flatnonzero(raw < 128)[n]) + 1
    out, at = [], head
    for size in decode_varints(data[:head])[1:].tolist():
        out.append(data[at : at + int(size)])
        at += int(size)
    return out


def _strings(values: list[str]) -> bytes:
    raw = [v.encode() for v in values]
    return _blobs([encode_varints(np.array([len(r) for r in raw])), b"".join(raw)])


def _unstrings(data: bytes) -> list[str]:
    sizes, body = _unblobs(data)
    ends = np.cumsum(decode_varints(sizes).astype(np.int64))
    return [body[a:b].decode() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _ints(values: np.ndarray) -> tuple[str, bytes]:
    diff = np.diff(values) if len(values) and np.abs(values).max() < LIMIT else None
    if diff is not None and entropy(values) >= (entropy(diff) if len(diff) else 0.0):
        return "delta", encode_ints(np.concatenate([values[:1], diff]))
    return "integer", encode_ints(values)


def encode_column(values: list[str], split: bool = True, share: float = DISTINCT_SHARE, kernel: str = "none") -> tuple[str, bytes]:
    """(meta as JSON, payload) of a column; the payload is packed by the kernel."""
    meta, body = _encode(values, split, share)
    return json.dumps({**meta, "kernel": kernel}), KERNELS[kernel](body)


def _encode(values: list[str], split: bool, share: float) -> tuple[dict, bytes]:
    if all(_integer.match(v) for v in values):
        kind, body = _ints(np.array([int(v) for v in values], np.int64))
        return {"kind": kind}, body
    if all(_digits.match(v) for v in values) and len({len(v) for v in values}) == 1:
        kind, body = _ints(np.array([int(v) for v in values], np.int64))
        return {"kind": "fixed", "length": len(values[0]), "inner": kind}, body
    distinct = list(dict.fromkeys(values))
    if split and len(distinct) > share * len(values):
        pattern = None
        for s in dict.fromkeys(_other.sub("", v) for v in values):
            pattern = s if pattern is None else string_lcs(pattern, s)
            if not pattern:
                break
        if pattern:
            parts: list[list[str]] = [[] for _ in range(len(pattern) + 1)]
            for v in values:
                for k, d in enumerate(pattern):
                    head, _, v = v.partition(d)
                    parts[k].append(head)
                parts[-1].append(v)
            done = [_encode(p, False, share) for p in parts]
            return {"kind": "pattern", "pattern": pattern, "parts": [m for m, _ in done]}, _blobs([b for _, b in done])
    if len(distinct) < share * len(values):
        number = {v: i for i, v in enumerate(distinct)}
        inner, body = _ints(np.array([number[v] for v in values], np.int64))
        return {"kind": "dictionary", "inner": inner}, _blobs([_strings(distinct), body])
    return {"kind": "string"}, _strings(values)


def decode_column(meta: str, payload: bytes) -> list[str]:
    m = json.loads(meta)
    return _decode(m, UNPACK[m["kernel"]](payload))


def _numbers(kind: str, body: bytes) -> np.ndarray:
    v = decode_ints(body)
    return np.cumsum(v) if kind == "delta" else v


def _decode(m: dict, body: bytes) -> list[str]:
    kind = m["kind"]
    if kind in ("integer", "delta"):
        return [str(v) for v in _numbers(kind, body).tolist()]
    if kind == "fixed":
        return [str(v).zfill(m["length"]) for v in _numbers(m["inner"], body).tolist()]
    if kind == "dictionary":
        names, ids = _unblobs(body)
        table = _unstrings(names)
        return [table[i] for i in _numbers(m["inner"], ids).tolist()]
    if kind == "pattern":
        parts = [_decode(p, b) for p, b in zip(m["parts"], _unblobs(body))]
        return ["".join(x + d for x, d in zip(row, m["pattern"] + "\0"))[:-1] for row in zip(*parts)]
    return _unstrings(body)


BLOCK = ["src", "block_id"]
ENCODED = "src string, block_id long, scope string, eid int, col int, n long, raw_bytes long, meta string, payload binary"
#: Rows of a batch that goes back to Spark.
SLICE = 10_000


def in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with those of a block next to each other in one partition, in the given order."""
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, *order)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((src, block_id), rows) of batches in which a block's rows are next to each other; one block is held at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        src, number = batch["src"].to_pylist(), batch["block_id"].to_pylist()
        start = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and number[end] == number[start] and src[end] == src[start]:
                continue
            if held and (src[start], number[start]) != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = (src[start], number[start])
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield key, pa.Table.from_batches(held)


def columns_of(rows: pa.Table, head_length: int) -> Iterator[tuple[str, int, int, list[str]]]:
    """(scope, eid, col, values) of a block's rows: ids E and numbers N of all records; header fields H, their separators D and template slots V of loaded ones."""
    eid = rows["eid"].to_numpy()
    yield "E", 0, 0, list(map(str, eid.tolist()))
    yield "N", 0, 0, list(map(str, rows["rec_no"].to_pylist()))
    good = np.flatnonzero(eid > 0)
    if head_length and len(good):
        heads = rows["head"].take(pa.array(good)).combine_chunks()
        # a header ends with a separator
        for scope, pattern, first in (("H", "[ \\t|]+", 0), ("D", "[^ \\t|]+", 1)):
            parts = pc.split_pattern_regex(heads, pattern)
            for col in range(head_length):
                yield scope, 0, col, pc.list_element(parts, col + first).to_pylist()
    for k in np.unique(eid[good]).tolist():
        slots = rows["vars"].take(pa.array(np.flatnonzero(eid == k))).combine_chunks()
        for col in range(len(slots[0])):
            yield "V", k, col, pc.list_element(slots, col).to_pylist()


def encoded_columns(parsed: DataFrame, head_length: int, kernel: str = "lzma", split: bool = True, share: float = DISTINCT_SHARE) -> DataFrame:
    """(src, block_id, scope, eid, col, n, raw_bytes, meta, payload), one row per column of a source's block; parsed lines have (src, block_id, rec_no, eid, head, vars)."""
    names = [f.split()[0] for f in ENCODED.split(", ")]
    kinds = dict(zip(names, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())))

    def encode(batches):
        done, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), kinds.values())], names=names)
        for key, rows in blocks(batches):
            for scope, eid, col, values in columns_of(rows, head_length):
                meta, payload = encode_column(values, split, share, kernel)
                done.append((*key, scope, eid, col, len(values), sum(len(v.encode()) + 1 for v in values), meta, payload))
                size += len(payload)
                if len(done) >= SLICE or size >= 1 << 23:
                    yield out()
                    done, size = [], 0
        if done:
            yield out()

    rows = parsed.select(*BLOCK, "rec_no", "eid", F.when(F.col("eid") > 0, F.col("head")).alias("head"), "vars")
    return in_blocks(rows, "rec_no").mapInArrow(encode, ENCODED)


def packed_sizes(encoded: DataFrame, kernels: list[str]) -> DataFrame:
    """(kernel, bytes): what the columns with their meta take by each kernel; every column is encoded once and packed by all of them."""

    def pack(batches):
        for pdf in batches:
            sizes = dict.fromkeys(kernels, 0)
            for meta, payload in zip(pdf.meta, pdf.payload):
                m = json.loads(meta)
                body = UNPACK[m["kernel"]](bytes(payload))
                for k in kernels:
                    sizes[k] += len(json.dumps({**m, "kernel": k})) + len(KERNELS[k](body))
            yield pd.DataFrame(sizes.items(), columns=["kernel", "bytes"])

    return encoded.select("meta", "payload").mapInPandas(pack, "kernel string, bytes long").groupBy("kernel").agg(F.sum("bytes").alias("bytes"))


def _joined(parts: list) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(""))


def restored_block(columns: pa.Table, templates: dict[int, list[str]]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rec_no, lines), slice by slice, of a block's loaded records, from its columns."""
    found = {(r["scope"], r["eid"], r["col"]): decode_column(r["meta"], r["payload"]) for r in columns.to_pylist()}
    eid, numbers = (np.array(found.pop((scope, 0, 0)), np.int64) for scope in "EN")
    if len(eid) != len(numbers):
        raise ValueError("the block's columns differ in length")
    numbers, eid = numbers[eid > 0], eid[eid > 0]
    # of each record, its number among those of its template
    nth = np.zeros(len(eid), np.int64)
    values = {name: pa.array(v, pa.string()) for name, v in found.items()}
    for k in np.unique(eid).tolist():
        if k not in templates:
            raise ValueError(f"the archive's template {k} is missing")
        nth[eid == k] = np.arange(int((eid == k).sum()))
    for start in range(0, len(eid), SLICE):
        some = slice(start, start + SLICE)
        heads = [values["HD"[o], 0, col][some] for col in range(sum(s == "H" for s, _, _ in values)) for o in (0, 1)]
        bodies, places = [], []
        for k in np.unique(eid[some]).tolist():
            at = np.flatnonzero(eid[some] == k)
            own = slice(int(nth[some][at[0]]), int(nth[some][at[-1]]) + 1)
            parts, col = [pa.array([""] * len(at), pa.string())], 0
            for token in templates[k]:
                parts.append(values["V", k, col][own] if token == WILD else pa.scalar(token))
                col += token == WILD
            bodies.append(_joined(parts))
            places.append(at)
        body = pa.concat_arrays(bodies).take(pa.array(np.argsort(np.concatenate(places))))
        yield numbers[some], _joined([*heads, body])


def compressed(lines: DataFrame, templates: DataFrame, head_length: int, kernel: str = "lzma", split: bool = True, layout: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables of lines (block_id, rec_no, line and, where there are several sources, src): encoded columns, and failed records (src, block_id, rec_no, raw).

    A block belongs to one source; without a src, or where it is null, that is
    the empty text. The ids of all records form the column of scope E, as in
    the log order.
    """
    src = F.coalesce(F.col("src"), F.lit("")) if "src" in lines.columns else F.lit("")
    parsed = matched(lines.withColumn("src", src), templates, head_length, layout)
    # both tables are made of it
    parsed = written(parsed.select(*BLOCK, "rec_no", "eid", "head", "vars", F.when(F.col("eid") <= 0, F.col("line")).alias("raw")), "parsed")
    return encoded_columns(parsed, head_length, kernel, split), parsed.filter("eid <= 0").select(*BLOCK, "rec_no", "raw")


def restored(encoded: DataFrame, failed: DataFrame, templates: DataFrame) -> DataFrame:
    """(src, block_id, rec_no, line): columns decoded, records filled from their template and united with the failed ones."""
    known = {r.eid: r.tokens for r in templates.select("eid", "tokens").limit(MAX_TEMPLATES + 1).collect()}
    if len(known) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")

    def decode(batches):
        for (src, block), columns in blocks(batches):
            for numbers, lines in restored_block(columns, known):
                yield pa.RecordBatch.from_arrays([pa.array([src] * len(lines), pa.string()), pa.array([block] * len(lines), pa.int64()), pa.array(numbers, pa.int64()), lines], names=[*BLOCK, "rec_no", "line"])

    columns = encoded.select(*BLOCK, "scope", "eid", "col", "meta", "payload")
    good = in_blocks(columns).mapInArrow(decode, "src string, block_id long, rec_no long, line string")
    return good.union(failed.select(*BLOCK, "rec_no", "raw"))
