"""Quality rules on repetition inside a text.

Words are runs without white space. For n-grams of 5, 7 and 10 words, rolling
hashes over the words find n-grams that occurred earlier in the same text;
equal hashes of words, n-grams and lines are confirmed on what they stand for,
so no hash decides a count; what counts is the share of the words' characters that lie in such
repeats (overlaps once), and the share in lines equal to an earlier line. A
text fails if a share exceeds its limit (the longer the n-gram, the lower), or
by the base rule: fewer than 50 words, or more than half of the words in
3-word windows that the text has twice or more.

Everything is computed for a whole batch of texts at once in numpy. Texts are
never cut: a text longer than a chunk forms a chunk of its own.

Cases: null and empty texts have no words, all counts 0, and fail by the base
rule; texts of fewer words than n have no n-grams; rows are kept one to one,
repeated rows included; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loglattice.llm.flat import Lean, chunks, covered, flat, repeats, slice_classes, totals, window_classes, words_of

#: Largest share of characters in n-grams that occurred earlier, by n, and in lines that did.
LIMITS, LINE_LIMIT = {5: 0.15, 7: 0.13, 10: 0.10}, 0.20
MIN_WORDS, WINDOW = 50, 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in LIMITS]]


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of COUNTS for texts laid end to end."""
    n_texts = len(offsets) - 1
    starts, ends, text_of = words_of(data, offsets)
    chars = (data & 0xC0) != 0x80
    so_far = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars, out=so_far[1:])
    sizes = so_far[ends] - so_far[starts]
    per_text = lambda values, of: np.bincount(of, values, n_texts).astype(np.int64)
    out = {"n_words": np.bincount(text_of, minlength=n_texts), "word_chars": per_text(sizes, text_of), "n_symbols": totals(SYMBOLS[data], offsets)}

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_text = np.searchsorted(offsets[:-1], line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_text + 1])
    cut = np.zeros(len(data) + 1, bool)
    cut[breaks] = True
    line_ends -= cut[np.maximum(line_ends - 1, 0)] & (line_ends > line_starts)
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    filled = words_before[1] > words_before[0]
    line_starts, line_ends, line_text = line_starts[filled], line_ends[filled], line_text[filled]
    first_word, end_word = words_before[0][filled], words_before[1][filled]
    _, later = repeats(slice_classes(data, line_starts, line_ends, line_text))
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=n_texts)
    size_sums = np.concatenate([[0], np.cumsum(sizes)])
    out["dup_line_chars"] = per_text((size_sums[end_word] - size_sums[first_word])[later], line_text[later])

    for n, at, classes in window_classes(slice_classes(data, starts, ends), text_of, (WINDOW, *LIMITS)):
        twice, later = repeats(classes)
        marks = np.zeros(len(starts), bool)
        marks[at] = twice if n == WINDOW else later
        inside = covered(marks, n, len(starts))
        if n == WINDOW:
            out["n_repeat_words"] = np.bincount(text_of[inside], minlength=n_texts)
        else:
            out[f"dup_{n}gram_chars"] = per_text(sizes[inside], text_of[inside])
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    over = m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for n, limit in LIMITS.items():
        over |= m[f"dup_{n}gram_chars"] > limit * m["word_chars"]
    return failed, ~failed & ~over


def rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, base_failed and kept to every row."""
    names = [*COUNTS, "base_failed", "kept"]
    rest = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                m = measures(*flat(part.column(text)))
                failed, kept = verdicts(m)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], *[pa.array(m[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(kept)], names=[*[f.name for f in rest], *names])

    return df.mapInArrow(Lean(run), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rules(docs).drop("text")


def _dup(n: int) -> str:
    gram = " || chr(0) || ".join(f"lead(w, {k}) over p" for k in range(n))
    return f"""select r, i from (select r, i, g, row_number() over (partition by r, g order by i) as nth from
      (select r, i, {gram} as g from w window p as (partition by r order by i)) where g is not null) where nth > 1"""


OP5_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, line, j from (select r, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as j from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ld as (select r, line, row_number() over (partition by r, line order by j) > 1 as dup from l),
lc as (select r, sum(len(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ''))) as chars, count(*) as n from ld where dup group by r),
w as (select r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w, unnest(range(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')))) as i from d),
wc as (select r, count(*) as n_words, sum(length(w)) as chars from w group by r),
t3 as (select r, i from (select r, i, count(*) over (partition by r, g) as n from
      (select r, i, w || chr(0) || lead(w) over p || chr(0) || lead(w, 2) over p as g from w window p as (partition by r order by i)) where g is not null) where n > 1),
r3 as (select r, count(*) as n from (select distinct r, i + k as i from t3, range(3) as x(k)) group by r),
{", ".join(f"g{n} as (select w.r, sum(length(w.w)) as chars from w join (select distinct r, i + k as i from ({_dup(n)}) as y, range({n}) as x(k)) as z on z.r = w.r and z.i = w.i group by w.r)" for n in LIMITS)},
m as (select d.doc_id, coalesce(wc.n_words, 0)::bigint as n_words, coalesce(wc.chars, 0)::bigint as word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(lc.n, 0)::bigint as n_dup_lines,
        coalesce(r3.n, 0)::bigint as n_repeat_words, coalesce(lc.chars, 0)::bigint as dup_line_chars,
        {", ".join(f"coalesce(g{n}.chars, 0)::bigint as dup_{n}gram_chars" for n in LIMITS)}
      from d left join wc using (r) left join lc using (r) left join r3 using (r) {" ".join(f"left join g{n} using (r)" for n in LIMITS)}),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and not (dup_line_chars > {LINE_LIMIT}::double * word_chars {"".join(f" or dup_{n}gram_chars > {v}::double * word_chars" for n, v in LIMITS.items())}) as kept from f
"""
