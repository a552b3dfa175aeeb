"""Near-duplicate documents by b-bit MinHash.

1. A text's set is its distinct word n-grams (A-Z lower-cased, words without
   white space; a text of fewer words is one n-gram; none without words).
   128 linear permutations give the set's minima. Groups of minima form
   bands; the low 4 bits of all minima, packed in 64 bytes, are the signature.
2. Texts with equal sets form a class; only classes go on.
3. Classes that share a band are candidates. Bands with the same members are
   looked at once. Within a bucket, the number of equal nibbles of two packed
   signatures (bit counts of their exclusive or) estimates the similarity,
   corrected for chance agreement of 4 bits.
4. Links are confirmed on the full sets. Not all pairs are listed: a bucket
   proposes a maximum spanning forest of the estimates, whose confirmed links
   give components. Where a bucket then still has several components, the
   members outside its largest one are compared with all others of the bucket
   on the full sets within a task, and only links that join two components
   leave it. A component is found without its inner pairs, and no link between
   components is lost but by an estimate off by more than `margin` (over 4.5
   standard deviations) or bands that miss (less than one in a million at the
   threshold).
5. Buckets of more than BLOCK members are dealt to blocks; to the other blocks
   go only members outside the bucket's largest component (at first the
   smallest member alone), so a hot bucket costs no quadratic work once it has
   merged.

Cases: null texts and texts without words have an empty set (n_shingles 0) and
are their own component. Equal texts, repeated rows and tied doc_ids share a
class; component_id is the smallest doc_id that is reachable (null doc_ids
don't count while others exist). An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import written
from loglattice.llm.components import components
from loglattice.llm.flat import Lean, blocks, chunks, flat, hashed, mixed, whole_groups, window_keys, words_of

PERMUTATIONS, LOW_BITS, BLOCK = 128, 4, 2048
#: Sets are at most so many in a broadcast list of ids; beyond that the join is shuffled.
MAX_BROADCAST_IDS = 500_000
KEEP_BITS = np.uint64((1 << 48) - 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_mix = np.random.default_rng(20240607)
FACTORS = _mix.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
SHIFTS = _mix.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


@dataclass(frozen=True)
class Settings:
    """Share of the union that the intersection must reach is percent / 100."""

    words: int = 5
    percent: int = 80
    rows: int = 4
    bands: int = 28
    margin: float = 0.16


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts (sorted within each) and the texts' offsets in them."""
    data = LOWER[data]
    starts, ends, text_of = words_of(data, offsets)
    n_texts = len(offsets) - 1
    counts = np.bincount(text_of, minlength=n_texts)
    words = hashed(blocks(data), starts, ends - starts)
    _, grams = next(window_keys(words, (n,)))
    at = np.arange(len(grams))
    at = at[text_of[at] == text_of[at + n - 1]] if len(at) else at
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < n))
    short = mixed(counts[few].astype(np.uint64))
    for k in range(n - 1):
        more = counts[few] > k
        short[more] = mixed(short[more] ^ words[first[few[more]] + k]) + np.uint64(k + 1)
    keys = np.concatenate([grams[at], short])
    owner = np.concatenate([text_of[at], few])
    bits = max(1, int(n_texts).bit_length())
    packed = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits)))
    if len(packed):
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    owner = (packed >> np.uint64(64 - bits)).astype(np.int64)
    sizes = np.bincount(owner, minlength=n_texts)
    #: 48 bits that don't depend on the batch: the top bits of the hash.
    return ((packed << np.uint64(bits)) >> np.uint64(16)) & KEEP_BITS, np.concatenate([[0], np.cumsum(sizes)])


def minima(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima for each nonempty set, as rows."""
    filled = ends[:-1][np.diff(ends) > 0]
    values = (mixed(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(filled), PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        out[:, k] = np.minimum.reduceat(values * FACTORS[k] + SHIFTS[k], filled)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """Low 4 bits of each minimum, two to a byte."""
    low = (least & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def band_keys(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    key = np.zeros((len(least), bands), np.uint64)
    for r in range(rows):
        key = mixed(key ^ least[:, r : rows * bands : rows].astype(np.uint64)) + np.arange(bands, dtype=np.uint64)
    return mixed(key).view(np.int64)


def digests(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-free 128-bit digest of each set, as two columns."""
    out = np.zeros((len(ends) - 1, 2), np.uint64)
    for k in range(2):
        sums = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mixed(sets + np.uint64(0x51ED2701 * (k + 1))), out=sums[1:])
        out[:, k] = mixed(sums[ends[1:]] - sums[ends[:-1]] + np.uint64(k))
    return out


def _signatures(s: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, ends = shingles(*flat(part.column("text")), s.words)
                sizes = np.diff(ends)
                least = minima(sets, ends)
                keys, bits, ids = band_keys(least, s.rows, s.bands), packed_bits(least), digests(sets, ends)
                raw = np.ascontiguousarray(ids).tobytes()
                filled = np.flatnonzero(sizes)
                place = np.full(len(sizes), -1)
                place[filled] = np.arange(len(filled))
                v = pa.array([raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)], pa.binary())
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, s.bands, 0))]).astype(np.int32)), pa.array(keys.ravel()))
                sig = pa.array([bits[p].tobytes() if p >= 0 else None for p in place], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sizes.astype(np.int64)), v, bands, sig], names=["doc_id", "text_hash", "n_shingles", "v", "bands", "sig"])

    return run


def _sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, ends = shingles(*flat(part.column("text")), words)
                six = np.ascontiguousarray(sets.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array([six[6 * a : 6 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())], names=["v", "items"])

    return run


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one signature to many, from packed nibbles as 64-bit words."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 1 / (1 << LOW_BITS)
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def spanning(sig: np.ndarray, low: float) -> list[tuple[int, int]]:
    """Maximum spanning forest (edges of at least low) over the members, grown from the first that is left."""
    n = len(sig)
    best, link = np.full(n, -1.0), np.full(n, -1)
    out, left = [], np.ones(n, bool)
    for _ in range(n):
        k = int(np.argmax(np.where(left, best, -2.0)))
        if best[k] >= low:
            out.append((int(link[k]), k))
        left[k] = False
        if not left.any():
            break
        e = estimates(sig[k], sig)
        nearer = left & (e > best)
        best[nearer], link[nearer] = e[nearer], k
    return out


def items_of(blob: bytes) -> np.ndarray:
    """The 48-bit hashes of a set, sorted."""
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (0, 2))).view("<u8").ravel()


def joined(sig: np.ndarray, label: np.ndarray, loose: np.ndarray, sets: list[np.ndarray], low: float, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels within a bucket's block: each loose member against all others, on the full sets.

    Members that no other label comes near by the estimate are passed over. The
    sizes of a member's intersections with all others come from one count over
    the block's postings; only links that merge two labels are returned.
    """
    sizes = np.array([len(x) for x in sets])
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_word = np.argsort(place, kind="stable")
    posting, first = owner[by_word], np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(words)))])
    ends = np.cumsum(sizes)
    out = []
    for i in np.flatnonzero(loose):
        if not ((label != label[i]) & (estimates(sig[i], sig) >= low)).any():
            continue
        own = place[ends[i] - sizes[i] : ends[i]]
        counts = first[own + 1] - first[own]
        index = np.repeat(first[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        same = np.bincount(posting[index], minlength=len(sets))
        linked = 100 * same >= percent * (sizes + sizes[i] - same)
        for j in np.flatnonzero(linked & (label != label[i])):
            if label[j] != label[i]:
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def _proposals(low: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g = table["g"].to_numpy()
            v = table["v"].to_pylist()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint64).reshape(len(v), -1)
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            a, b = [], []
            for s, t in zip(edge.tolist(), edge[1:].tolist()):
                for i, j in spanning(sig[s:t], low) if t - s > 1 else []:
                    x, y = v[s + i], v[s + j]
                    a.append(min(x, y))
                    b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _joining(low: float, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g = table["g"].to_numpy()
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            for s, t in zip(edge.tolist(), edge[1:].tolist()):
                part = table.slice(s, t - s)
                v, labels = part["v"].to_pylist(), part["label"].to_pylist()
                number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                if len(number) < 2:
                    continue
                sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint64).reshape(len(v), -1)
                pairs = joined(sig, np.array([number[x] for x in labels]), part["loose"].to_numpy(zero_copy_only=False), [items_of(x) for x in part["items"].to_pylist()], low, percent)
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for i, _ in pairs], pa.binary()), pa.array([v[j] for _, j in pairs], pa.binary())], names=["a", "b"])

    return run


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = items_of(x.as_py()), items_of(y.as_py())
                small, large = min(len(one), len(two)), max(len(one), len(two))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([one, two]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(one) + len(two) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) for every row of docs."""
    spark = docs.sparkSession
    low = s.percent / 100 - s.margin
    all_docs = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(Lean(_signatures(s)), "doc_id long, text_hash long, n_shingles long, v binary, bands array<long>, sig binary"), "signatures")
    classes = all_docs.filter("v is not null").groupBy("v").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    banded = classes.select("v", F.explode("bands").alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(v))").alias("who"), F.min("v").alias("least")).filter("n > 1")
    # written first: a join of two plain shuffles lets adaptive execution split the rows of a hot bucket
    buckets = written(counts.groupBy("n", "who").agg(F.min("key").alias("key"), F.first("least").alias("least")), "buckets")
    members = written(banded.join(buckets, "key").join(classes.select("v", "sig"), "v").select("key", "v", "sig", "least", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "members")
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")

    def dealt(rows: DataFrame, visits: Column, *more: str) -> DataFrame:
        """g: the member's own block of its bucket and, for visitors, every other block."""
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
        at = F.when(visits & (F.col("blocks") > 1), F.concat(F.array("own"), others)).otherwise(F.array("own"))
        return rows.withColumn("own", own).withColumn("block", F.explode(at)).select(F.xxhash64("key", "block").alias("g"), "v", "sig", *more).repartition("g").sortWithinPartitions("g", "v")

    pairs = dealt(members, F.col("v") == F.col("least")).mapInArrow(Lean(_proposals(low)), "a binary, b binary").distinct()
    sets = _full_sets(docs, all_docs, members, s)
    x, y = sets.select(F.col("v").alias("a"), F.col("items").alias("x")), sets.select(F.col("v").alias("b"), F.col("items").alias("y"))
    links = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(Lean(_confirm(s.percent)), "a binary, b binary"), "confirmed")
    labels = components(links)

    labelled = members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    main = written(labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("c", "label")).alias("main")).filter("parts > 1").select("key", "main"), "main")
    loose = labelled.join(main, "key").withColumn("loose", F.col("label") != F.col("main")).join(sets, "v")
    more = written(dealt(loose, F.col("loose"), "label", "loose", "items").mapInArrow(Lean(_joining(low, s.percent)), "a binary, b binary"), "joining")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = classes.select("v", "first").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "label").select("v", "component_id")
    out = all_docs.select("doc_id", "text_hash", "n_shingles", "v").join(by_class, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def _full_sets(docs: DataFrame, all_docs: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """(v, items) of the classes in some bucket, from one text of each class."""
    #: doc_ids may be tied or null: the hash tells the texts of one id apart.
    wanted = all_docs.select("doc_id", "text_hash", "v").join(members.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.min(F.struct("doc_id", "text_hash")).alias("_w"))
    wanted = written(wanted.select("v", F.col("_w.doc_id").alias("_d"), F.col("_w.text_hash").alias("_h")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = hashed.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("v", "text")
    return written(texts.groupBy("v").agg(F.min("text").alias("text")).mapInArrow(Lean(_sets(s.words)), "v binary, items binary"), "sets")


CONTRACT = Settings(words=3, percent=85, rows=5, bands=25, margin=0.15)


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), CONTRACT)
