"""Best-fit packing of documents into sequences of fixed capacity by bin completion.

Documents become token ids plus one separator; those longer than the capacity
are cut into full pieces, the first of which may be shorter. Only the piece
lengths decide the packing, and there are at most `capacity` of them, so the
plan is made on their histogram, whatever the number of documents.

The plan is a branch-and-bound over bins. Best-fit decreasing is the first
incumbent. Around the longest length that is left, the undominated fillings of
the remaining room are enumerated in order of waste; each is used as often as
the counts allow, and fewer times on backtracking. Within a filling, bit sets
of the sums that shorter lengths can still reach bound the waste of a branch
exactly, so no branch is entered that can't end in the wanted waste. A filling
is dominated if another piece still fits, or if some of its pieces could be
exchanged for one longer piece that is left and fits in their place and the
waste. Over the plan, a branch is cut when its waste exceeds what one sequence
less than the incumbent leaves. The search ends at a lower bound (total length,
and lengths above half the capacity) or after `nodes` fillings, which bounds the
driver's work; `packing_plan` returns the bound, so the gap is known.

Pieces of one length are interchangeable: each gets a rank among its length
from counts per (length, hash bucket), so that a very common length is not
ranked in one task, and the rank gives its sequence and place.

Cases: null and empty texts give a piece of the separator alone; an empty
table gives no rows; repeated rows, tied and null doc_ids are packed one by one; extra
columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.bytebpe import ByteBpe
from loglattice.llm.common import written
from loglattice.llm.flat import Lean, chunks, flat

CAPACITY, SEPARATOR = 2048, 0
#: Fillings that the search may try.
NODES = 4_000


def cut_lengths(total: int, capacity: int) -> list[int]:
    first = total % capacity or capacity
    return [first, *[capacity] * ((total - first) // capacity)]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, real: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if real, ids of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            for part in chunks(batch, "text"):
                bpe = bpe or ByteBpe(path)
                ids, ends = bpe.encode(*flat(part.column("text")))
                rows, piece, start, length, crc, blobs = [], [], [], [], [], []
                raw = np.insert(ids, ends[1:], separator).astype("<u4")
                ends = ends + np.arange(len(ends))
                view = memoryview(raw.tobytes())
                for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                    at = a
                    for p, n in enumerate(cut_lengths(b - a, capacity)):
                        rows.append(k)
                        piece.append(p)
                        start.append(at - a)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                        if real:
                            blobs.append(raw[at : at + n].astype(np.int64))
                        at += n
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if real:
                    columns, names = [*columns, pa.array(blobs, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(Lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * real)


def reachable(room: int, counts: list[int], lengths: list[int]) -> list[int]:
    """For k = 0.. the sums up to room that the first k lengths can make with their counts, as bits."""
    mask, sums = (1 << room + 1) - 1, 1
    out = [sums]
    for n in lengths:
        left, times = min(counts[n], room // n), 1
        while left > 0:
            step = min(times, left)
            sums |= (sums << n * step) & mask
            left, times = left - step, 2 * times
        out.append(sums)
    return out


def fillings(room: int, top: int, counts: list[int], most: int) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths) of the undominated fillings of a room by lengths of at most `top`, by waste (up to `most`), those of longer pieces first."""
    lengths = [n for n in range(1, min(room, top) + 1) if counts[n]]
    sums = reachable(room, counts, lengths)
    chosen: list[int] = []

    def visit(k: int, target: int) -> Iterator[list[int]]:
        if not target:
            yield chosen.copy()
            return
        while lengths[k - 1] > target:
            k -= 1
        for j in range(k, 0, -1):
            n = lengths[j - 1]
            if not sums[j] >> target & 1:
                return
            for times in range(min(counts[n], target // n), 0, -1):
                if sums[j - 1] >> target - n * times & 1:
                    chosen.extend([n] * times)
                    yield from visit(j - 1, target - n * times)
                    del chosen[-times:]

    def dominated(found: list[int], waste: int) -> bool:
        used, inside = Counter(found), 1
        for n in found:
            inside |= inside << n
        window = (1 << waste) - 1
        return any(counts[m] > used[m] and (m <= waste or inside >> m - waste & window) for m in lengths)

    for waste in range(min(most, room) + 1):
        if sums[-1] >> room - waste & 1:
            for found in visit(len(lengths), room - waste):
                if not waste or not dominated(found, waste):
                    yield waste, found


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound: for each k, pieces above capacity - k have bins of their own, those above half too, and the rest down to k fill what these leave."""
    at_least = [0] * (capacity + 2)
    weight = [0] * (capacity + 2)
    for n in range(capacity, 0, -1):
        c = histogram.get(n, 0)
        at_least[n], weight[n] = at_least[n + 1] + c, weight[n + 1] + n * c
    half = capacity // 2 + 1
    best = -(-weight[1] // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = at_least[capacity - k + 1]
        halves = at_least[half] - alone
        spare = halves * capacity - (weight[half] - weight[capacity - k + 1])
        best = max(best, alone + halves + max(0, -(-(weight[k] - weight[half] - spare) // capacity)))
    return best


Plan = list[tuple[list[int], int]]


def completed(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """(lengths, times) of the best plan that the search finds."""
    best = best_fit(histogram, capacity)
    size, bound = sum(t for _, t in best), least_bins(histogram, capacity)
    total = sum(n * c for n, c in histogram.items())
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    plan: Plan = []
    used = waste = 0

    def branches(top: int) -> Iterator[tuple[list[int], int]]:
        while counts[top] == 0:
            top -= 1
        counts[top] -= 1
        try:
            found = fillings(capacity - top, top, counts, (size - 1) * capacity - total - waste)
            first = next(found, None)
        finally:
            counts[top] += 1
        while first:
            pattern = [top, *first[1]]
            need = Counter(pattern)
            for times in range(min(counts[n] // k for n, k in need.items()), 0, -1):
                yield pattern, times
            counts[top] -= 1
            try:
                first = next(found, None)
            finally:
                counts[top] += 1

    def put(pattern: list[int], times: int) -> None:
        for n in pattern:
            counts[n] -= times

    stack = [branches(capacity)] if histogram else []
    while stack and size > bound and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan and len(plan) > len(stack) - 1:
                pattern, times = plan.pop()
                put(pattern, -times)
                used, waste = used - times, waste - times * (capacity - sum(pattern))
            continue
        nodes -= 1
        pattern, times = step
        lost = times * (capacity - sum(pattern))
        if waste + lost > (size - 1) * capacity - total:
            continue
        put(pattern, times)
        plan.append((pattern, times))
        used, waste = used + times, waste + lost
        top = pattern[0]
        while top and not counts[top]:
            top -= 1
        if top:
            stack.append(branches(top))
            continue
        best, size = plan.copy(), used
        pattern, times = plan.pop()
        put(pattern, -times)
        used, waste = used - times, waste - lost
    return best


def packing_plan(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[Plan, int, int]:
    """The plan, its number of sequences, and the lower bound on it."""
    plan = completed(histogram, capacity, nodes)
    return plan, sum(t for _, t in plan), least_bins(histogram, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """(lengths, times) of best-fit decreasing, on counts: each piece goes to the fullest bin that has room, bins of one room together."""
    bins: dict[int, list[tuple[list[int], int]]] = {}
    for n in range(capacity, 0, -1):
        left = histogram.get(n, 0)
        for room in sorted(r for r in bins if r >= n):
            # bins of this room take one piece each, then those of the room that this leaves are fuller still
            while left and bins.get(room) and room >= n:
                pattern, times = bins[room].pop()
                each = min(room // n, left)
                take = min(times, left // each)
                if times > take:
                    bins[room].append((pattern, times - take))
                bins.setdefault(room - n * each, []).append((pattern + [n] * each, take))
                left -= take * each
            if not bins.get(room):
                bins.pop(room, None)
        while left:
            each = min(capacity // n, left)
            take = left // each
            bins.setdefault(capacity - n * each, []).append(([n] * each, take))
            left -= take * each
    return [b for some in bins.values() for b in some]


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For ranks of each length: where a run of them begins, its first sequence and its offset, by key length << 40 | rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for n in pattern:
            rows.append(((n << 40) | taken.get(n, 0), sequence, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        sequence += times
    rows.sort()
    key, first, at = np.array(rows, np.int64).reshape(-1, 3).T
    return {"key": key, "sequence": first, "offset": at}


def packed(pieces: DataFrame, capacity: int = CAPACITY, n_buckets: int = 64, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to every piece; `pieces` is read twice, so it should be a written table."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(packing_plan(histogram, capacity, nodes)[0])
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n")).select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))).join(bases, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_k") - 1)
    names = pieces.columns
    given = ranked.select(*names, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = (batch.column("length").to_numpy().astype(np.int64) << 40) | batch.column("_rank").to_numpy()
            slot = np.searchsorted(table["key"], key, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(table["sequence"][slot] + key - table["key"][slot]), pa.array(table["offset"][slot])], names=[*names, "sequence_id", "offset"])

    return given.mapInArrow(Lean(run), ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields], "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, real: bool = True) -> DataFrame:
    """Tokenize, cut and pack documents; with real=False without the ids themselves."""
    n = min(4096, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packed(written(tokenized(docs, path, capacity, separator, real), "pieces"), capacity, n)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), real=False)
