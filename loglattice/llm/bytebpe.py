"""Byte-level BPE token ids of batches of texts.

The published splitting pattern of this tokenizer family (contractions, runs
of letters, numbers or other characters with one leading space, runs of white
space) is evaluated for a whole batch in numpy from character classes. Equal
words have equal ids, so only words not met before go to the tokenizer; a
worker remembers a bounded number of them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from loglattice.llm.flat import slice_classes

LETTER, NUMBER, OTHER, SPACE = range(4)
KNOWN_WORDS = 300_000
#: Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[WHITE_SPACE] = SPACE
    return out


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin; `ends` are the texts' offsets in code points."""
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[ends] = True
    kind = classes()[points]
    space = kind == SPACE
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (points[:-1] == 32) & ~first[1:-1]
    begins = np.where(space, run, run & ~blank_before)
    begins[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
    at = np.flatnonzero((points == 39) & run & ~blank_before)
    if len(at):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[at + 1], padded[at + 2]
        whole = ~edge[at + 1]
        single = whole & np.isin(one, [ord(c) for c in "stmd"])
        pair = (one.astype(np.int64) << 32) | two
        double = whole & ~edge[at + 2] & np.isin(pair, [(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")])
        for hit, size in ((single, 2), (double, 3)):
            here = at[hit]
            for k in range(1, size):
                begins[here + k] = False
            after = here + size
            after = after[(after < n)]
            begins[after] = True
    return np.flatnonzero(begins)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The merges of a tokenizers file as ranks: in this family a token's id is its rank, whatever the words."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sorted(special), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


class ByteBpe:
    """Ids of texts, with a bounded memory of words."""

    def __init__(self, path: str):
        self.encoding, self.special, self.special_ids = encoding(path)
        self.known: dict[bytes, np.ndarray] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' offsets in them."""
        raw = data.tobytes()
        text = raw.decode("utf-8")
        if any(s in text for s in self.special):
            return self._with_special(data, offsets)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lead = (data & 0xC0) != 0x80
        char_at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=char_at[1:])
        begin = np.flatnonzero(lead)[word_starts(points, char_at[offsets])]
        end = np.append(begin[1:], len(data))
        _, first, number = np.unique(slice_classes(data, begin, end), return_index=True, return_inverse=True)
        words = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        found = []
        for w in words:
            ids = self.known.get(w)
            if ids is None:
                ids = self.known[w] = np.array(self.encoding.encode_ordinary(w.decode("utf-8")), np.uint32)
            found.append(ids)
        sizes = np.array([len(ids) for ids in found], np.int64)
        place, every = (np.cumsum(sizes) - sizes)[number], np.concatenate(found)
        sizes = sizes[number]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        index = np.repeat(place - total[:-1], sizes) + np.arange(total[-1])
        return every[index], total[np.searchsorted(begin, offsets)]

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string: it becomes that token, as the tokenizers library does."""
        import regex

        cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        parts, ends = [], [0]
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            n = 0
            for piece in cut.split(data[a:b].tobytes().decode("utf-8")):
                ids = [self.special_ids[piece]] if piece in self.special_ids else self.encoding.encode_ordinary(piece)
                parts.append(np.array(ids, np.uint32))
                n += len(ids)
            ends.append(ends[-1] + n)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array(ends, np.int64)
