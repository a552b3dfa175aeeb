"""Batches of texts as flat numpy arrays; hashes of their slices, and exact classes of equal slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CHUNK_ROWS = 1 << 19, 1 << 13
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Lean:
    """An Arrow function that gives freed memory back to the system when its task ends, so that idle workers stay small."""

    def __init__(self, run: Callable):
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` bytes of text and CHUNK_ROWS rows each, or one row."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.dtype("int64")
    else:
        column, width = column.cast(pa.string()), np.dtype("int32")
    _, places, data = column.buffers()
    if not len(column) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What counts of an 8-byte block of which so many bytes belong to the slice.
TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on (zeros beyond the end) as numbers; a view of a padded copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def slice_blocks(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 8-byte blocks of all slices (one for an empty slice), each block's number in its slice, and where each slice's blocks begin."""
    counts = np.maximum((sizes + 7) >> 3, 1)
    firsts = np.cumsum(counts) - counts
    which = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(which)) - firsts[which]
    return view[starts[which] + 8 * nth] & TAILS[np.minimum(sizes[which] - 8 * nth, 8)], nth, firsts


def hashed(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice: the sum of its blocks, each spread with its number by a function that isn't linear."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    value, nth, firsts = slice_blocks(view, starts, sizes)
    return mixed(np.add.reduceat(mixed(value ^ (nth.astype(np.uint64) + np.uint64(1)) * BASE), firsts) + sizes.astype(np.uint64) * BASE)


def equal_slices(view: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Are the slices of the same sizes at a and at b the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    one, _, firsts = slice_blocks(view, a, sizes)
    return np.logical_and.reduceat(one == slice_blocks(view, b, sizes)[0], firsts)


def numbered(keys: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray], value: Callable[[int], object]) -> np.ndarray:
    """Class numbers of items, the same for the same items only.

    Keys are a filter: items of one key are confirmed by `equal` (items at two
    arrays of places), and where that fails once, `value` tells the key's items
    apart.
    """
    out = np.zeros(len(keys), np.int64)
    if not len(keys):
        return out
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.flatnonzero(ranked[1:] == ranked[:-1])
    held = equal(order[at], order[at + 1])
    fresh = np.ones(len(keys), bool)
    fresh[at[held] + 1] = False
    out[order] = np.cumsum(fresh) - 1
    if not held.all():
        top = len(keys)
        for key in np.unique(ranked[at[~held]]).tolist():
            seen: dict = {}
            for i in order[np.searchsorted(ranked, np.uint64(key)) : np.searchsorted(ranked, np.uint64(key), "right")].tolist():
                out[i] = seen.setdefault(value(i), top + len(seen))
            top += len(seen)
        out = np.unique(out, return_inverse=True)[1]
    return out


def slice_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Class numbers of slices of bytes: equal exactly for equal bytes (of one owner, where that is given)."""
    view, sizes = blocks(data), ends - starts
    keys = hashed(view, starts, sizes)
    of = np.zeros(len(starts), np.int64) if owner is None else owner
    if owner is not None:
        keys ^= mixed(owner.astype(np.uint64) + np.uint64(1))

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (sizes[a] == sizes[b]) & (of[a] == of[b])
        out[out] = equal_slices(view, starts[a[out]], starts[b[out]], sizes[a[out]])
        return out

    return numbered(keys, equal, lambda i: (int(of[i]), data[starts[i] : ends[i]].tobytes()))


def window_keys(values: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ascending sizes a hash of all windows of so many neighbouring values, in order."""
    keys = np.full(len(values), BASE)
    for k in range(max(sizes)):
        keys = mixed(keys[: max(0, len(values) - k)] ^ values[k:].astype(np.uint64)) + np.uint64(k + 1)
        if k + 1 in sizes:
            yield k + 1, keys


def window_classes(values: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: the places of windows within one owner, and exact class numbers of them (equal values, same owner)."""
    for n, keys in window_keys(values, sizes):
        at = np.arange(len(keys))
        at = at[owner[at] == owner[at + n - 1]] if len(at) else at

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = at[a], at[b]
            out = owner[a] == owner[b]
            for k in range(n):
                out &= values[a + k] == values[b + k]
            return out

        yield n, at, numbered(keys[at] ^ mixed(owner[at].astype(np.uint64) + np.uint64(1)), equal, lambda i: (int(owner[at[i]]), *values[at[i] : at[i] + n].tolist()))


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between neighbouring offsets; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs without white space."""
    inside = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once; has it occurred at an earlier place."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    ranked = keys[order]
    same[1:] = ranked[1:] == ranked[:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    same[:-1] |= same[1:]
    twice[order] = same
    return twice, later


def covered(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Places inside a window of n that begins at a marked place."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(marks)
    edge[at] += 1
    edge[np.minimum(at + n, size)] -= 1
    return np.cumsum(edge[:-1]) > 0


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a sorted key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = int(change[-1]) if len(change) else 0
        if held and (len(change) or held[-1].column(key)[-1].as_py() != keys[0]):
            cut = last if held[-1].column(key)[-1].as_py() == keys[0] else 0
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
            if not cut and last:
                yield pa.Table.from_batches([batch.slice(0, last)])
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
