"""SentencePiece encoding and decoding with vectorised merge rounds.

A batch's texts become one flat array of symbols. Places where no piece of the
vocabulary could ever span are cut, so the batch falls into short words, and
only distinct words are encoded (those seen before are kept, by their
characters, in a bounded cache). Encoding runs in rounds over all open words at once: ranks of
neighbouring pairs are looked up in a hash table, the least rank of each word
is found by a segmented minimum, its leftmost non-overlapping occurrences are
merged at once, and the arrays are compacted, until no pair remains. Where the
new piece could itself form a pair of a better or equal rank, only the first
occurrence of the word is merged in that round, so the result is that of the
one-at-a-time rule. Characters without a piece become byte pieces.

Decoding joins the surfaces of the pieces, byte pieces as bytes, and drops the
one leading space that encoding adds.

Cases: null and empty texts give the end id alone and decode to the empty
string. Rows are kept one to one, repeated rows included; texts are encoded
whole, whatever their length; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loglattice.llm.flat import Lean, chunks, flat, slice_classes

NONE = np.int32(2**31 - 1)
SPACE = "▁"
SLOTS = 1 << 20
CACHE_WORDS = 300_000
NEAR = 0x600


class PairTable:
    """Open-addressing table from (left, right) ids to the rank and id of the merged piece."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], size: int):
        self.size = size
        self.keys = np.full(SLOTS, -1, np.int64)
        self.rank, self.merged = np.full(SLOTS, NONE, np.int32), np.zeros(SLOTS, np.int32)
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        slot, left = self.slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = keys[left[put]], values[left[put], 0], values[left[put], 1]
            left = left[~put]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            self.probes += 1

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.size + right
        slot = self.slot(keys)
        place = np.full(len(keys), -1, np.int64)
        held = self.keys[slot]
        hit = held == keys
        place[hit] = slot[hit]
        rest = np.flatnonzero(~hit & (held >= 0))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            place[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (held >= 0)]
        found = place >= 0
        return np.where(found, self.rank[place], NONE), np.where(found, self.merged[place], 0)


class Pieces:
    """Tables of one model, read through the library; encoding and decoding are done here."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        text = [library.id_to_piece(i) for i in range(size)]
        score = [library.get_score(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        self.end = library.eos_id()
        self.byte = np.zeros(256, np.int32)
        for i in range(size):
            if library.is_byte(i):
                self.byte[int(text[i][3:5], 16)] = i
        self.size = size
        own = {t: i for i, t in enumerate(text) if not special[i]}
        order = {s: r for r, s in enumerate(sorted({score[i] for i in own.values()}, reverse=True))}
        pairs = {}
        best_part = np.full(size, NONE, np.int64)
        for t, i in own.items():
            for k in range(1, len(t)):
                a, b = own.get(t[:k]), own.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[score[i]], i)
                    best_part[[a, b]] = np.minimum(best_part[[a, b]], order[score[i]])
        rank_of = np.full(size, NONE, np.int64)
        for i in own.values():
            rank_of[i] = order[score[i]]
        #: Pieces that can't take part in a pair as good as the one that made them.
        self.safe = best_part > rank_of
        self.pairs = PairTable(pairs, size)
        self.char = np.full(0x110000, -1, np.int32)
        for t, i in own.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        #: joins[a, b]: some piece holds the characters a, b in a row. Characters beyond NEAR are never cut from others that have a piece.
        self.joins = np.zeros((NEAR + 1, NEAR + 1), bool)
        self.joins[NEAR], self.joins[:, NEAR] = True, True
        place = lambda c: NEAR if c == SPACE else min(ord(c), NEAR)
        self.space_joins = np.zeros((2, NEAR + 1), bool)
        for t in own:
            for a, b in zip(t, t[1:]):
                if a == SPACE or b == SPACE:
                    self.space_joins[int(b == SPACE), place(b if a == SPACE else a)] = True
                else:
                    self.joins[place(a), place(b)] = True
        self.surface = [b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(text)]
        for value, i in enumerate(self.byte):
            self.surface[i] = bytes([value])

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Where a word may begin: no piece holds the character before and this one in a row."""
        near = np.minimum(points, NEAR)
        is_space = points == ord(SPACE)
        out = np.ones(len(points), bool)
        a, b = near[:-1], near[1:]
        joined = self.joins[a, b]
        after = is_space[:-1]
        joined[after] = self.space_joins[0, b[after]]
        before = is_space[1:]
        joined[before] = self.space_joins[1, a[before]]
        joined &= (self.char[points[:-1]] >= 0) & (self.char[points[1:]] >= 0)
        out[1:] = ~joined
        return out

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, in order, and how many each has; symbols are character ids (>= size: no piece)."""
        n_words = len(starts)
        word = np.repeat(np.arange(n_words), np.diff(np.append(starts, len(symbols))))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            into = np.zeros(len(symbols), np.int32)
            inner = np.flatnonzero((word[1:] == word[:-1]) & (symbols[1:] < self.size) & (symbols[:-1] < self.size))
            rank[inner], into[inner] = self.pairs.find(symbols[inner], symbols[inner + 1])
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.append(begins, len(symbols)))
            least = np.minimum.reduceat(rank, begins)
            open_ = least < NONE
            if not open_.all():
                shut = np.repeat(~open_, sizes)
                done.append((word[shut], symbols[shut]))
                stay = ~shut
                symbols, word, rank, into = symbols[stay], word[stay], rank[stay], into[stay]
                least, sizes = least[open_], sizes[open_]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(least, sizes)
            at = np.flatnonzero(chosen)
            first_of_run = np.r_[True, np.diff(at) > 1]
            run = at[np.maximum.accumulate(np.where(first_of_run, np.arange(len(at)), 0))]
            take = (at - run) % 2 == 0
            risky = ~self.safe[into[at]]
            if risky.any():
                words_at = word[at]
                risky_word = np.zeros(n_words, bool)
                risky_word[words_at[risky]] = True
                first_of_word = np.r_[True, words_at[1:] != words_at[:-1]]
                take &= ~risky_word[words_at] | first_of_word
            at = at[take]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
        words, ids = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=n_words)

    def words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Ids of each word given as a range of code points."""
        sizes = ends - starts
        firsts = np.cumsum(sizes) - sizes
        index = np.repeat(starts - firsts, sizes) + np.arange(sizes.sum())
        own = points[index]
        ids = self.char[own]
        lost = ids < 0
        ids = np.where(lost, self.size + own.astype(np.int32), ids).astype(np.int32)
        merged, counts = self.merge(ids, firsts)
        flat_ids, out, at = merged.tolist(), [], 0
        for n in counts.tolist():
            one = flat_ids[at : at + n]
            at += n
            if n and max(one) >= self.size:
                one = [int(y) for x in one for y in ([x] if x < self.size else self.byte[list(chr(x - self.size).encode())])]
            out.append(one)
        return out


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts of one worker; remembers a bounded number of words."""

    def __init__(self, path: str):
        self.pieces, self.known = model(path), {}
        self.sizes, self.decimal, self.plain = [], [], []

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: number of ids with the end id, the ids as decimals joined by spaces, and the decoded text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.sizes, self.decimal, self.plain = [], [], []
        text = data.tobytes().decode("utf-8").replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        ends = lead[offsets]
        filled = np.flatnonzero(np.diff(ends) > 0)
        where = ends[filled]
        points = np.insert(points, where, ord(SPACE))
        begins = where + np.arange(len(where))
        cut = self.pieces.cuts(points) if len(points) else np.zeros(0, bool)
        cut[begins] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(points))
        _, first, which = np.unique(slice_classes(points.view(np.uint8), 4 * starts, 4 * stops), return_index=True, return_inverse=True)
        known, raw = self.known, points.tobytes()
        words = [raw[4 * a : 4 * b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]
        slots = [known.get(w, -1) for w in words]
        fresh = [k for k, s in enumerate(slots) if s < 0]
        if fresh:
            at = first[fresh]
            for k, ids in zip(fresh, self.pieces.words(points, starts[at], stops[at])):
                slots[k] = known[words[k]] = len(self.sizes)
                self.sizes.append(len(ids))
                self.decimal.append(" ".join(map(str, ids)).encode())
                self.plain.append(b"".join([self.pieces.surface[i] for i in ids]))
        decimal, plain = [self.decimal[s] for s in slots], [self.plain[s] for s in slots]
        sizes = np.array([self.sizes[s] for s in slots], np.int64)[which]
        counts = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.searchsorted(starts, np.append(begins, len(points)))
        of, end = which.tolist(), str(self.pieces.end).encode()
        at = 0
        for n in np.diff(ends).tolist():
            if not n:
                yield 1, end, b""
                continue
            a, b = int(bounds[at]), int(bounds[at + 1])
            at += 1
            mine = of[a:b]
            yield int(counts[b] - counts[a]) + 1, b" ".join([decimal[k] for k in mine] + [end]), b"".join([plain[k] for k in mine])[1:]


def encoded(df: DataFrame, path: str, text: str = "text", real: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if real, ids (array) and decoded (text) to every row."""
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if real:
        added += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    names = [n for n, _ in added]
    rest = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*rest, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in chunks(batch, text):
                encoder = encoder or Encoder(path)
                rows = list(encoder.batch(*flat(part.column(text))))
                columns = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for _, i, _ in rows]), pa.array([hashlib.sha256(d).hexdigest() for _, _, d in rows])]
                if real:
                    columns += [pa.array([np.array(i.split(), np.int32) for _, i, _ in rows], pa.list_(pa.int32())), pa.array([d.decode() for _, _, d in rows])]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], *columns], names=[*[f.name for f in rest], *names])

    return df.mapInArrow(Lean(run), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), real=False).drop("text")
