"""Deterministic sharded WARC archives: write, commit, read back.

Records are range-sorted by id into shards of about equal row counts; borders
are quantiles of the ids, and an id that fills shards on its own is cut by its
digests. Every record is a gzip member of its own;
headers are made anew for each record (record id and dates from the content,
block and payload digests, lengths), so the same rows give the same bytes. A
shard starts a new file when the compressed size passes the limit. Files are
written under a temporary name of the task attempt and renamed when complete;
the manifest (file, records, bytes, digest) is a table written from what the
successful attempts returned, and readers open only files that it names, so
lost or doubled attempts leave nothing that is read; their temporary files are
deleted when the manifest is complete.

Reading checks each file against the manifest's digest and each block against
its header; a response's size and digest are computed again from the block it
carries, and a revisit's (`resolved`) come from the archived response that it
names, which must have the digest that the revisit states.

Of records with equal payloads of at least 100 bytes the one of smallest id is
the response and the others are revisits, which carry the digest and the
response's id instead of the payload.

Cases: ids may span all longs. A null payload is empty; payloads under 100 bytes are all responses;
rows are kept one to one, repeated rows included: all rows with the smallest
id of a payload are responses. Null ids sort first, have no id header and are
read back as null; they are revisits if some row with an id has the same
payload. An empty table gives an empty manifest and no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import order_buckets, scratch_path, written
from loglattice.llm.flat import Lean

LEAST_REVISIT = 100
FILE_BYTES = 32 << 20
MAX_BROADCAST_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"


def store(path: str):
    """(file system, path in it) of any URI that Spark's shared folder may have."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with headers made from its content."""
    block = payload if kind == "response" else b""
    name = f"{page_id}|{digest}|{kind}"
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in (url or "urn:none"))
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}|{digest}|response')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest, kind, refers_to.

    Digests of several records are a narrow table: broadcast while they are few,
    so that payloads are not shuffled here, and joined by a shuffle beyond that.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    first = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = written(first, "first")
    joined = rows.join(F.broadcast(first) if first.count() <= MAX_BROADCAST_DIGESTS else first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str, n_shards: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write classified records as shards under `folder`; returns the committed manifest."""
    spark = records.sparkSession
    placed = records.withColumn("shard", order_buckets(records, "page_id", "digest", n_shards).bucket).repartition(n_shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        state: dict = {}

        def close() -> pa.RecordBatch:
            state["out"].close()
            name = f"part-{state['shard']:06d}-{state['number']:04d}.warc.gz"
            try:
                system.move(state["temp"], f"{root}/{name}")
            except OSError:  # another attempt has put the same bytes there, on a store that renames onto nothing
                if system.get_file_info(f"{root}/{name}").size != state["bytes"]:
                    raise
            row = [[state["shard"]], [name], [state["records"]], [state["bytes"]], [state["sha"].hexdigest()]]
            state["out"] = None
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "file", "records", "bytes", "sha256"])

        for batch in batches:
            for r in batch.to_pylist():
                if state.get("out") and (state["shard"] != r["shard"] or state["bytes"] >= file_bytes):
                    yield close()
                if not state.get("out"):
                    number = state["number"] + 1 if state.get("shard") == r["shard"] else 0
                    temp = f"{root}/.tmp-{uuid.uuid4().hex}"
                    state = {"shard": r["shard"], "number": number, "temp": temp, "out": system.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                data = member(record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["kind"], r["refers_to"]))
                state["out"].write(data)
                state["sha"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
        if state.get("out"):
            yield close()

    from pyarrow.fs import FileSelector

    system, root = store(folder)
    system.create_dir(root, recursive=True)
    placed.mapInArrow(Lean(run), MANIFEST).write.parquet(f"{folder}/manifest")
    for left in system.get_file_info(FileSelector(root)):
        if left.base_name.startswith(".tmp-"):
            system.delete_file(left.path)
    return spark.read.parquet(f"{folder}/manifest")


def members(stream, buffer: int = 1 << 20, step: int = 1 << 13) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time; fed in small steps, as what is left of a step is copied after each member."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(buffer):
        at = 0
        while at < len(data):
            fed = data[at : at + step]
            parts.append(z.decompress(fed))
            at += len(fed) - len(z.unused_data)
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a member is cut short")


class Digested:
    """A stream that keeps the digest of what was read."""

    def __init__(self, raw):
        self.raw, self.sha = raw, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.raw.read(size)
        self.sha.update(data)
        return data


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(manifest: DataFrame, folder: str, contents: bool = True) -> DataFrame:
    """Records of the files that the manifest names; each file's, block's and response's digest is checked. payload_bytes of revisits is null (see `resolved`)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * contents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * contents]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * contents]
        rows: list[tuple] = []
        held = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        coded = lambda value: bytes.fromhex(value) if len(value) == 64 else base64.b32decode(value)
        for batch in batches:
            for file, sha in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist()):
                with system.open_input_stream(f"{root}/{file}", compression=None) as raw:
                    stream = Digested(raw)
                    for one in members(stream):
                        h, block = parsed(one)
                        found = hashlib.sha256(block).digest()
                        stated, response = coded(h["WARC-Payload-Digest"][7:]), h["WARC-Type"] == "response"
                        if found != coded(h["WARC-Block-Digest"][7:]) or response and found != stated:
                            raise ValueError(f"{file}: a block differs from its digest")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        row = (number("X-Page-Id"), h["WARC-Target-URI"], len(block) if response else None, (found if response else stated).hex(), h["WARC-Type"], number("X-Refers-To-Page"))
                        rows.append((*row, block) if contents else row)
                        held += len(block) if contents else 100
                        if held > 8 << 20:
                            yield flush()
                            rows, held = [], 0
                    if stream.sha.hexdigest() != sha:
                        raise ValueError(f"{file} differs from the manifest")
        if rows:
            yield flush()

    return manifest.select("file", "sha256").mapInArrow(Lean(run), schema)


def resolved(records: DataFrame) -> DataFrame:
    """Revisits get their payload_bytes from the response they name, found by its id and digest; one without it is an error. `records` is read several times, so it should be a written table."""
    again = records.filter("record_type = 'revisit'")
    asked = again.select(F.col("refers_to").alias("_p"), F.col("payload_digest").alias("_d")).distinct()
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).distinct().join(asked, ["_p", "_d"])
    held = written(held, "responses")
    side = F.broadcast(held) if held.count() <= MAX_BROADCAST_DIGESTS else held
    found = again.join(side, (F.col("refers_to") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    size = F.coalesce("_n", F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("refers_to").cast("string"))).cast("bigint"))
    return records.filter("record_type <> 'revisit'").unionByName(found.withColumn("payload_bytes", size).select(*records.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write(classified(pages), folder, 4 * n)
    return resolved(written(read(manifest.repartition(n), folder, contents=False).drop("url"), "records"))


OP4_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first is not null and p.page_id <> f.first then 'revisit' else 'response' end as record_type,
       case when f.first is not null and p.page_id <> f.first then f.first end as refers_to
from p left join f on f.payload_digest = p.payload_digest and p.payload_bytes >= 100
"""
