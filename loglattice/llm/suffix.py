"""Removal of passages that repeat anywhere in the corpus, by suffix arrays.

A byte is removed if some string of 200 bytes that covers it also starts at
another place, in the same text or another one.

1. Candidates. Every window of 200 bytes has an anchor: of its 64-byte strings
   the one with the least hash (the leftmost of equal ones). Neighbouring
   windows with the same anchor form a super-window, about one per 69 bytes.
   Equal windows have equal anchors, so only super-windows whose anchor hash
   occurs twice can hold a repeat. Two anchors of one hash cost work, nothing
   else: a hash never decides what is removed.
2. Shards. The candidate regions of whole texts are dealt to shards of bounded
   size. Each shard builds the suffix array of its regions by
   Larsson-Sadakane refinement (ranks by 8 bytes, then doubled, unsorted groups
   only, up to the width; every region ends in its own terminator) and common
   prefixes by Kasai's rule in its permuted form: only places where the
   preceding bytes differ are compared, the others lose one byte each.
   Neighbours with 200 bytes in common mark their windows.
3. Merging. Each shard emits one sorted run of its distinct super-windows, by
   128-bit BLAKE2 digests. Runs are cut at range borders (as many ranges as the
   data need) and merged in pairs, each looked up in the other by binary
   search; super-windows found in two shards repeat as a whole. Many runs are
   merged in groups first, and one entry of a digest goes on from each group,
   so a passage that every shard has does not gather in one task.
4. Edges. Super-windows that share an anchor without being equal can still
   share windows: one of each digest goes to a shard of its anchor, where
   suffix array and common prefixes are built as in 2. An anchor with more than
   SPLIT of them is dealt to several shards, whose distinct windows are merged
   likewise, as sorted runs cut at range borders.
5. Marks become byte spans of documents, which are united and removed.

Cases: null and empty texts and those under 200 bytes keep everything; of
equal texts of 200 bytes or more nothing stays in any copy; repeated rows and
tied or null doc_ids are places like others. Extra columns pass through, those
with the names of results (kept, n_bytes, n_removed, n_spans, kept_sha256) or
of inner columns (k1, k2, starts, sizes, anchors) are replaced. Texts are never
cut; those above SEGMENT are searched for anchors segment by segment, and their
regions may lie in several shards. The kept bytes can break a UTF-8 sequence:
`kept` is binary, `text` drops such fragments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import written
from loglattice.llm.flat import Lean, blocks, chunks, flat, mixed, whole_groups

WIDTH, ANCHOR = 200, 64
SPLIT = 1_000
SEGMENT, SHARD_BYTES = 4 << 20, 1 << 19
RANGE_ROWS, GROUP_RUNS = 200_000, 4_096
#: Prefixes are compared for all places at once up to so many bytes, then place by place.
FAR = 256
MAX_BROADCAST_KEYS = 500_000
SIGN = np.uint64(1 << 63)


def anchor_hashes(data: np.ndarray, anchor: int) -> np.ndarray:
    """A hash of the `anchor` bytes (8 times a power of 2) from every place, by doubling."""
    keys, size = mixed(blocks(data)[: max(0, len(data) - 7)]), 8
    while size < anchor:
        keys = mixed(keys[:-size] * np.uint64(3) + keys[size:]) if len(keys) > size else keys[:0]
        size *= 2
    return keys


def super_windows(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """text, start (in the text), n windows and anchor hash of every super-window."""
    empty = {c: np.zeros(0, np.int64) for c in ("text", "start", "n", "anchor")}
    if len(data) < width:
        return empty
    grams = anchor_hashes(data, anchor)
    places = np.arange(len(grams))
    bits = np.uint64(int(len(data)).bit_length())
    least = (mixed(grams) >> bits << bits) | places.astype(np.uint64)
    span, size = width - anchor + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + width <= offsets[1:][text])
    if not len(starts):
        return empty
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (text[starts[1:]] != text[starts[:-1]])
    first = np.flatnonzero(new)
    begin = starts[first]
    return {"text": text[begin], "start": begin - offsets[text[begin]], "n": np.diff(np.append(first, len(starts))), "anchor": grams[at[begin]].view(np.int64)}


def _windows(segment: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = flat(part.column("text"))
                for low in range(0, len(data), segment) if len(offsets) == 2 else [0]:
                    cut = offsets if len(offsets) > 2 else np.array([0, min(segment + WIDTH - 1, len(data) - low)])
                    w = super_windows(data[low : low + cut[-1]], cut)
                    who = pa.array(w["text"])
                    yield pa.RecordBatch.from_arrays([part.column("k1").take(who), part.column("k2").take(who), pa.array(w["start"] + low), pa.array(w["n"].astype(np.int32)), pa.array(w["anchor"])], names=["k1", "k2", "start", "n", "anchor"])

    return run


def _initial(text: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """The next 8 bytes of every place as one number; places past the segment's end count as 0."""
    key = blocks(text)[: len(text)].byteswap()
    left = end_of - np.arange(len(text))
    short = np.flatnonzero(left < 8)
    shift = (8 * (8 - left[short])).astype(np.uint64)
    key[short] = key[short] >> shift << shift
    return key


def suffix_array(text: np.ndarray, ends: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of segments laid end to end, each closed by its own terminator (earlier ones smaller), and the ranks; with a limit, suffixes that agree in so many bytes stay in order of place."""
    n = len(text)
    sizes = np.diff(np.concatenate([[0], ends]))
    segment = np.repeat(np.arange(len(ends)), sizes)
    end_of = ends[segment]
    key = _initial(text, end_of)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    begin = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = begin
    last = np.append(head[1:], True)
    open_ = np.flatnonzero(~(head & last))
    h = 8
    while len(open_) and (limit is None or h < limit):
        who = order[open_]
        ahead = who + h
        # beyond the end: the segment's terminator, below every rank
        second = np.where(ahead < end_of[who], rank[np.minimum(ahead, n - 1)] + len(ends), segment[who])
        group = begin[open_]
        by = np.lexsort((second, group)) if n + len(ends) >= 1 << 31 else np.argsort((group << 32) | second, kind="stable")
        who, group, second = who[by], group[by], second[by]
        order[open_] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        begin_new = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))]
        rank[who] = begin_new
        begin[open_] = begin_new
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]
        h *= 2
    return order, rank


def common_length(text: np.ndarray, a: int, b: int, room: int) -> int:
    """Bytes in common from a and b on, at most room, by steps of doubled size."""
    n, step = 0, FAR
    while n < room:
        step = min(2 * step, room - n)
        differ = text[a + n : a + n + step] != text[b + n : b + n + step]
        if differ.any():
            return n + int(differ.argmax())
        n += step
    return n


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the text: bytes in common with its predecessor in the suffix array (Kasai's rule)."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    segment = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    end_of = ends[segment]
    first = np.zeros(n, bool)
    first[np.concatenate([[0], ends[:-1]])[np.diff(np.concatenate([[0], ends])) > 0]] = True
    places = np.arange(n)
    known = (places > 0) & (before > 0)
    known &= ~first & ~first[np.maximum(before, 0)]
    known[known] = text[places[known] - 1] == text[before[known] - 1]
    # a predecessor's neighbour is only one byte longer if it precedes the neighbour's suffix too
    known[known] = before[places[known] - 1] == before[known] - 1
    compare = np.flatnonzero(~known & (before >= 0))
    length = np.zeros(n, np.int64)
    key = _initial(text, end_of)
    live, at = compare, 0
    while len(live) and at < FAR:
        a, b = live + at, before[live] + at
        room = np.minimum(end_of[live] - a, end_of[before[live]] - b)
        inside = room > 0
        live, a, b, room = live[inside], a[inside], b[inside], room[inside]
        same = key[a] == key[b]
        x = key[a] ^ key[b]
        equal = np.where(same, 8, 0)
        part = np.flatnonzero(~same)
        if len(part):
            shift = np.zeros(len(part), np.int64)
            for k in range(1, 8):
                shift += (x[part] >> np.uint64(8 * (8 - k))) == 0
            equal[part] = shift
        length[live] += np.minimum(equal, room)
        live = live[same & (room > 8)]
        at += 8
    for p in live.tolist():
        length[p] += common_length(text, p + at, int(before[p]) + at, int(min(end_of[p] - p, end_of[before[p]] - before[p])) - at)
    anchor = np.maximum.accumulate(np.where(~known, places, 0))
    return np.where(known, np.maximum(length[anchor] - (places - anchor), 0), length)


def repeated_windows(text: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of windows that start at two or more places; the suffix array's window starts in order, and each one's class there."""
    order, _ = suffix_array(text, ends, width)
    shared = common_prefixes(text, ends, order)[order] >= width
    shared[0] = False
    marks = np.zeros(len(text), bool)
    marks[order[shared]] = True
    marks[order[np.flatnonzero(shared) - 1]] = True
    segment = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    whole = np.arange(len(text)) + width <= segment
    cls = np.cumsum(~shared)
    fits = whole[order]
    return marks & whole, order[fits], cls[fits]


FOUND = [("d1", pa.int64()), ("d2", pa.int64()), ("run", pa.int64()), ("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]
FOUND_SCHEMA = ", ".join(f"{c} long" for c, _ in FOUND)


def found_rows(k1, k2, start: np.ndarray, n: np.ndarray, digest: np.ndarray | None = None, run: int = 0, anchor: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of FOUND: without digests marked runs of windows, with them entries of a sorted run."""
    size = len(start)
    none = pa.nulls(size, pa.int64())
    halves = [none, none] if digest is None else [pa.array((digest[:, k] ^ SIGN).view(np.int64)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*halves, none if digest is None else pa.array(np.full(size, run)), none if anchor is None else pa.array(anchor), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64))], names=[c for c, _ in FOUND])


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of slices, as two numbers each that sort like the digests."""
    raw, blake = data.tobytes(), hashlib.blake2b
    out = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    return np.frombuffer(out, ">u8").astype(np.uint64).reshape(-1, 2)


def distinct_sorted(digest: np.ndarray) -> np.ndarray:
    """The places of the first of each digest, in the digests' order."""
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    ranked = digest[order]
    return order[np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)]] if len(order) else order


def run_number(*parts: int) -> int:
    """A number for a shard's run, from what identifies its first entry."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = mixed(x ^ np.array([p], np.int64).view(np.uint64)) + np.uint64(1)
    return int(x.view(np.int64)[0])


def _by_text(shard_bytes: int) -> Callable:
    """Shards of whole texts' candidate regions: marked runs of windows, and the sorted run of each shard's super-windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = flat(part.column("text"))
                column = part.column("w")
                counts = np.diff(column.offsets.to_numpy())
                start, n, anchor = (column.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "anchor"))
                doc = np.repeat(np.arange(part.num_rows), counts)
                k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
                begin = offsets[doc] + start
                end = begin + n + WIDTH - 1
                before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
                shard = np.cumsum(end - np.maximum(begin, before)) // shard_bytes
                edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(0, np.int64)
                for s, t in zip(edge.tolist(), edge[1:].tolist()):
                    a, b, d = begin[s:t], end[s:t], doc[s:t]
                    fresh = np.r_[True, (a[1:] >= np.maximum.accumulate(b)[:-1]) | (d[1:] != d[:-1])]
                    low = a[fresh]
                    high = np.maximum.reduceat(b, np.flatnonzero(fresh))
                    ends = np.cumsum(high - low)
                    begins = ends - (high - low)
                    text = data[np.repeat(low - begins, high - low) + np.arange(ends[-1])]
                    marks, _, _ = repeated_windows(text, ends)
                    region, at, size = _runs(marks, begins, ends)
                    own = d[fresh][region]
                    yield found_rows(k1[own], k2[own], low[region] - offsets[own] + at, size)
                    digest = digests(data, a, b)
                    one = distinct_sorted(digest)
                    yield found_rows(k1[d[one]], k2[d[one]], start[s:t][one], n[s:t][one], digest[one], run_number(k1[d[0]], k2[d[0]], start[s]), anchor[s:t][one])

    return run


RUNS_SCHEMA = "k1 long, k2 long, start long, n long, r long, run long, blob binary"


def run_rows(k1, k2, start: np.ndarray, n: np.ndarray, r: list | None = None, run: int = 0, blob: list | None = None) -> pa.RecordBatch:
    """Rows of RUNS_SCHEMA: marked runs of windows, or for each range the part of a sorted run, packed."""
    size = len(start) if r is None else len(r)
    none = pa.nulls(size, pa.int64())
    columns = [none] * 4 if r is not None else [pa.array(x, pa.int64()) for x in (k1, k2, start.astype(np.int64), n.astype(np.int64))]
    more = [none, none, pa.nulls(size, pa.binary())] if r is None else [pa.array(r, pa.int64()), pa.array([run] * size, pa.int64()), pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *more], names=["k1", "k2", "start", "n", "r", "run", "blob"])


def _by_anchor(ranges: int) -> Callable:
    """Shards of super-windows that share anchors: marked runs of windows and, for split anchors, the sorted run of the distinct windows in parts by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g = table["g"].to_numpy()
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            for a, b in zip(edge.tolist(), edge[1:].tolist()):
                part = table.slice(a, b - a)
                blobs = [x.as_buffer() for x in part["bytes"]]
                text = np.frombuffer(b"".join(blobs), np.uint8)
                ends = np.cumsum([len(x) for x in blobs])
                begins = np.concatenate([[0], ends[:-1]])
                k1, k2, start = (part[c].to_numpy() for c in ("k1", "k2", "start"))
                marks, places, cls = repeated_windows(text, ends)
                seg, at, size = _runs(marks, begins, ends)
                yield run_rows(k1[seg], k2[seg], start[seg] + at, size)
                if part["split"][0].as_py():
                    places = places[np.r_[True, cls[1:] != cls[:-1]]]
                    digest = digests(text, places, places + WIDTH)
                    one = distinct_sorted(digest)
                    places, digest = places[one], digest[one]
                    seg = np.searchsorted(ends, places, "right")
                    rows = np.stack([digest[:, 0].astype(">u8").view(np.int64), digest[:, 1].astype(">u8").view(np.int64), k1[seg], k2[seg], start[seg] + places - begins[seg]], axis=1)
                    r = ((digest[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
                    yield run_rows(None, None, places, places, r[cut[:-1]].tolist(), int(g[a]), [rows[s:t].tobytes() for s, t in zip(cut.tolist(), cut[1:].tolist())])

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: the windows that the runs of two shards hold. A shard has a window once, so a range's copies of one are no more than shards."""
    for table in whole_groups(batches, "r"):
        r = table["r"].to_numpy()
        edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            runs = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 5) for x in table["blob"].slice(a, b - a)]
            keys = [np.ascontiguousarray(x[:, :2]).view("S16").ravel() for x in runs]
            twice = in_two(keys)
            for x, own in zip(runs, keys):
                at = np.searchsorted(twice, own)
                held = at < len(twice)
                held[held] = twice[at[held]] == own[held]
                yield run_rows(x[held, 2], x[held, 3], x[held, 4], np.ones(int(held.sum())))


def _runs(marks: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marks within segments: segment, start in it, length."""
    first = np.zeros(len(marks) + 1, bool)
    first[begins] = True
    open_ = marks.copy()
    open_[1:] &= ~marks[:-1] | first[1:-1]
    shut = marks.copy()
    shut[:-1] &= ~marks[1:] | first[1:-1]
    a, b = np.flatnonzero(open_), np.flatnonzero(shut)
    seg = np.searchsorted(ends, a, "right")
    return seg, a - begins[seg], b - a + 1


def in_two(runs: list[np.ndarray]) -> np.ndarray:
    """The keys (sorted) that two or more sorted runs hold: runs are merged in pairs, each looked up in the other by binary search."""
    doubled = [r[1:][r[1:] == r[:-1]] for r in runs]
    while len(runs) > 1:
        merged = runs[len(runs) & ~1 :]
        for a, b in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a, b)
            hit = at < len(a)
            hit[hit] = a[at[hit]] == b[hit]
            doubled.append(b[hit])
            merged.append(np.insert(a, at[~hit], b[~hit]))
        runs = merged
    return np.unique(np.concatenate(doubled))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and group: hit says that another run has the entry too (or that it was hit before), first is true for one entry of each digest."""
    for table in whole_groups(batches, "m"):
        m = table["m"].to_numpy()
        edge = np.flatnonzero(np.r_[True, m[1:] != m[:-1], True])
        halves = np.stack([table[c].to_numpy().view(np.uint64) ^ SIGN for c in ("d1", "d2")], axis=1)
        keys = np.ascontiguousarray(halves.astype(">u8")).view("S16").ravel()
        run = table["run"].to_numpy()
        rows = table.to_batches()[0] if table.num_rows and len(table.to_batches()) == 1 else table.combine_chunks().to_batches()[0]
        hit, first = np.zeros(len(m), bool), np.zeros(len(m), bool)
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            own = keys[a:b]
            cut = np.flatnonzero(np.r_[True, run[a + 1 : b] != run[a : b - 1], True])
            twice = in_two([own[s:t] for s, t in zip(cut.tolist(), cut[1:].tolist())])
            at = np.searchsorted(twice, own)
            held = at < len(twice)
            held[held] = twice[at[held]] == own[held]
            hit[a:b] = held
            first[a + np.unique(own, return_index=True)[1]] = True
        hit |= rows.column(rows.schema.get_field_index("hit")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c, _ in FOUND], pa.array(hit), pa.array(first)], names=[*[c for c, _ in FOUND], "hit", "first"])


def merged_runs(entries: DataFrame, total: int, name: str) -> DataFrame:
    """All entries of all runs with hit (its digest is in two runs or more) and first (true for one entry of each digest).

    Ranges of the digest bound a task's distinct digests, groups of runs its
    copies of one digest; while there are several groups, one entry of each
    digest and group goes to the next round.
    """
    ranges = max(1, -(-total // RANGE_ROWS))
    r = F.least(F.lit(ranges - 1), F.floor((F.col("d1").cast("double") / 2.0**64 + 0.5) * ranges).cast("long"))
    left, done = entries.withColumn("hit", F.lit(False)), None
    groups = -(-entries.select("run").distinct().count() // GROUP_RUNS)
    while True:
        groups = max(1, groups)
        m = r * groups + F.pmod(F.xxhash64("run"), F.lit(groups))
        out = written(left.withColumn("m", m).repartition("m").sortWithinPartitions("m", "run", "d1", "d2").mapInArrow(Lean(_merged), FOUND_SCHEMA + ", hit boolean, first boolean"), name)
        if groups == 1:
            return out if done is None else done.union(out)
        rest = out.filter("not first")
        done = rest if done is None else done.union(rest)
        left, groups = out.filter("first").drop("first"), groups // GROUP_RUNS


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the spans' bytes from each text."""
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, starts, sizes in zip(batch.column("text"), batch.column("starts"), batch.column("sizes")):
            raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            edge = np.zeros(len(raw) + 1, np.int64)
            a = starts.values.to_numpy()
            np.add.at(edge, a, 1)
            np.add.at(edge, a + sizes.values.to_numpy() - 1 + WIDTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_bytes.append(len(raw))
            n_removed.append(int(gone.sum()))
            n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            kept.append(raw[~gone].tobytes())
        rest = [c for c in batch.schema.names if c not in ("starts", "sizes", "text")]
        shas = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas)], names=[*rest, "text", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(k1, k2, start, n): runs of n repeated windows in the texts of a key."""
    rows = written(keyed.select("k1", "k2", "text").filter(F.octet_length("text") >= WIDTH).mapInArrow(Lean(_windows(SEGMENT)), "k1 long, k2 long, start long, n int, anchor long"), "windows")
    # written first: then both sides of the join are plain shuffles, and adaptive execution splits the rows of a hot anchor
    anchors = written(rows.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "anchors")
    by_text = rows.join(anchors, "anchor").groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "n", "anchor"))).alias("w"))
    by_text = written(by_text, "candidates")
    span = ["k1", "k2", "start", "n"]
    shards = written(_of_keys(keyed, by_text).select("k1", "k2", "text").join(by_text, ["k1", "k2"]).mapInArrow(Lean(_by_text(SHARD_BYTES)), FOUND_SCHEMA), "shards")
    inside = shards.filter("run is null").select(*span)
    entries = shards.filter("run is not null")
    merged = merged_runs(entries, entries.count(), "merged")
    across = merged.filter("hit").select(*span)

    several = merged.filter("first").groupBy("anchor").agg(F.count("*").alias("d")).filter("d > 1").withColumn("parts", F.when(F.col("d") > SPLIT, F.ceil(F.col("d") / SPLIT).cast("int")))
    edges = written(merged.filter("first").join(written(several.select("anchor", "parts"), "several"), "anchor"), "edges")
    total, split_windows = edges.agg(F.coalesce(F.sum(F.col("n") + WIDTH - 1), F.lit(0)), F.coalesce(F.sum(F.when(F.col("parts").isNotNull(), F.col("n"))), F.lit(0))).first()
    if not total:
        return inside.union(across)
    n_shards = max(1, -(-int(total) // SHARD_BYTES))
    shard = F.when(F.col("parts").isNotNull(), F.xxhash64("anchor", F.pmod(F.col("d2"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    wanted = edges.select(*span, shard.alias("g"), F.col("parts").isNotNull().alias("split"))
    pieces = _of_keys(keyed, written(wanted.select("k1", "k2").distinct(), "edge_keys")).select("k1", "k2", F.col("text").cast("binary").alias("raw"))
    segments = wanted.join(pieces, ["k1", "k2"]).select("g", "split", *span, F.substring(F.col("raw"), F.col("start").cast("int") + 1, (F.col("n") + WIDTH - 1).cast("int")).alias("bytes")).dropDuplicates(["k1", "k2", "start"])
    ranges = max(1, -(-int(split_windows) // RANGE_ROWS))
    sharded = written(segments.repartition("g").sortWithinPartitions("g").mapInArrow(Lean(_by_anchor(ranges)), RUNS_SCHEMA), "edge_shards")
    parts = sharded.filter("blob is not null").repartition("r").sortWithinPartitions("r", "run")
    return inside.union(across).union(sharded.filter("blob is null").select(*span)).union(parts.mapInArrow(Lean(_across), RUNS_SCHEMA).select(*span))


def _of_keys(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of these keys: a filter by a broadcast while the keys are few, so that other texts are not shuffled."""
    return keyed.join(F.broadcast(keys.select("k1", "k2")), ["k1", "k2"], "left_semi") if keys.count() <= MAX_BROADCAST_KEYS else keyed


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text, and kept (the exact bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    added = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    names = [c for c in docs.columns if c not in ("k1", "k2", "starts", "sizes", *added)]
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"))
    spans = repeated_spans(keyed)
    by_text = written(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("s")).select("k1", "k2", F.col("s.start").alias("starts"), F.col("s.n").alias("sizes")), "spans")
    rest = [c for c in names if c != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in rest], "k1 long, k2 long, text string, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    changed = _of_keys(keyed, by_text).join(by_text, ["k1", "k2"]).select(*rest, "k1", "k2", "text", "starts", "sizes").mapInArrow(Lean(_cut), schema)
    keys = by_text.select("k1", "k2")
    untouched = keyed.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys, ["k1", "k2"], "left_anti")
    raw = F.coalesce("text", F.lit(""))
    plain = untouched.select(*rest, "text", raw.cast("binary").alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))
    return plain.select(*names, *added).union(changed.select(*names, *added))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
