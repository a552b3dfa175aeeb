"""Operators on the whole corpus against brute force on small tables."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import components, minhash, suffix, warc


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    r = random.Random(seed)
    texts = [" ".join(words(r, r.randint(0, 120))) for _ in range(60)]
    base = words(r, 100)
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        texts.append(" ".join(w))
    texts += [texts[70], texts[70].upper(), "one", "ONE", "one two", "", None, "  "]
    return texts


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("settings", [minhash.CONTRACT, minhash.Settings()])
def test_near_duplicates(spark, settings, monkeypatch):
    rows = [(1000 - i, t) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, v int")
    want = brute_components(rows, settings.words, settings.percent)
    for block in (2048, 7):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, settings).collect()}
        assert got == {d: (n, c, c == d) for (d, _), (n, c) in zip(rows, want)}


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of six words here"), (None, "a b c d e f"), (2, None), (2, "")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter([(1, 1, True)] * 3 + [(None, 1, False)] + [(2, 2, True)] * 2)


@pytest.mark.parametrize("most", [minhash.MAX_BROADCAST_IDS, 0])
def test_near_duplicates_among_tied_and_null_ids(spark, most, monkeypatch):
    monkeypatch.setattr(minhash, "MAX_BROADCAST_IDS", most)
    r = random.Random(8)
    bases = [words(r, 120, 4000) for _ in range(6)]
    near = [" ".join([*b[:-1], "changed"]) for b in bases]
    for shared in (7, None):
        rows = [(shared, " ".join(b)) for b in bases] + [(100 + i, t) for i, t in enumerate(near)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter((x.doc_id, x.component_id) for x in minhash.near_duplicates(docs).collect())
        want = [(d, shared or 100 + i % 6) for i, (d, _) in enumerate(rows)]
        assert got == Counter(want)


def test_components(spark):
    r = random.Random(5)
    for links in ([(i, i + 1) for i in range(120)], [(0, i) for i in range(1, 50)], [(r.randrange(200), r.randrange(200)) for _ in range(150)], []):
        df = spark.createDataFrame(links, "a long, b long")
        label = {x: x for e in links for x in e}
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert {x.v: x.label for x in components.components(df).collect()} == label


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        gone = gone[:-1]
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [4000, 2])
def test_repeated_passages(spark, split, monkeypatch):
    monkeypatch.setattr(suffix, "SPLIT", split)
    r = random.Random(3)
    passage = " ".join(words(r, 60))
    texts = [None, "", "short", "a" * 700, "é" * 300, passage[:200], passage]
    texts += [" ".join(words(r, 80)) + passage[r.randrange(60) :] + " ".join(words(r, r.randrange(40))) for _ in range(25)]
    texts += [texts[10], texts[10], " ".join(words(r, 200))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")]
    out = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    want = brute_removed([t for _, t, _ in rows])
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out) == Counter((d, *w) for (d, _, _), w in zip(rows, want))
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in out)


def test_repeated_passages_empty(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(3)
    for trial in range(40):
        segments = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 9))] if trial % 3 else [b"a" * r.randint(1, 40) for _ in range(5)]
        text, ends = np.frombuffer(b"".join(segments), np.uint8), np.cumsum([len(x) for x in segments])
        order, _ = suffix.suffix_array(text, ends)
        every, at = [], 0
        for k, x in enumerate(segments):
            every += [([*x[i:], k - 1000], at + i) for i in range(len(x))]
            at += len(x)
        every.sort()
        assert order.tolist() == [i for _, i in every]
        common = suffix.common_prefixes(text, ends, order)
        for (a, _), (b, j) in zip(every, every[1:]):
            n = next(k for k in range(len(b)) if k >= len(a) or a[k] != b[k])
            assert common[j] == n


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/é b", big, 1), (1, "http://b/", big, 1), (2, None, None, 1), (7, "http://c/", "tiny", 1), (8, "http://d/", "tiny", 1), (None, "http://e/", big, 1), (1, "http://b/", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    runs = []
    for k in range(2):
        folder = f"file://{tmp_path}/w{k}"
        manifest = warc.write(warc.classified(pages), folder, 3, file_bytes=200)
        runs.append(sorted((r.file, r.sha256, r.records) for r in manifest.collect()))
        assert not list(tmp_path.glob(f"w{k}/.tmp-*"))
        out = warc.resolved(warc.read(manifest, folder))
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest == hashlib.sha256((dict((a, c) for a, _, c, _ in rows)[r.page_id] or "").encode()).hexdigest()) for r in out.collect())
        assert got == Counter([(1, 203, "response", None, True)] * 2 + [(3, 203, "revisit", 1, True), (None, 203, "revisit", 1, True), (2, 0, "response", None, True), (7, 4, "response", None, True), (8, 4, "response", None, True)])
        assert {bytes(r.payload) for r in out.filter("record_type = 'response' and page_id = 7").collect()} == {b"tiny"}
    assert runs[0] == runs[1] and len(runs[0]) > 1
    empty = warc.write(warc.classified(pages.filter("false")), f"file://{tmp_path}/e", 2)
    assert empty.count() == 0 and warc.resolved(warc.read(empty, f"file://{tmp_path}/e")).count() == 0


def test_warc_reading_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame([(-(2**63), "http://a/", "x" * 300), (2**63 - 1, "http://b/", "x" * 300), (0, None, "y" * 5000), (None, None, "")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / ".tmp-lost").write_bytes(b"of an attempt that was lost")
    manifest = warc.write(warc.classified(pages), folder, 3)
    assert not list(tmp_path.glob("w/.tmp-*"))
    records = warc.read(manifest, folder)
    assert {(r.page_id, r.payload_bytes) for r in warc.resolved(records).collect()} == {(-(2**63), 300), (2**63 - 1, 300), (0, 5000), (None, 0)}
    with pytest.raises(Exception, match="no response"):
        warc.resolved(records.filter("page_id <> -9223372036854775808")).collect()
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read(manifest.withColumn("sha256", F.lit("0")), folder).collect()
    raw = zlib.decompress(warc.member(warc.record(1, None, b"abc", hashlib.sha256(b"abd").hexdigest(), "response", None)), 31)
    (tmp_path / "w" / "bad.warc.gz").write_bytes(warc.member(raw))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark.createDataFrame([("bad.warc.gz", "")], "file string, sha256 string"), folder).collect()


def test_members_of_small_records():
    raw = [b"%d" % i * (i % 50) for i in range(4000)]
    packed = b"".join(map(warc.member, raw))
    assert list(warc.members(io.BytesIO(packed), buffer=10_000)) == raw
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[:-5])))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(9)
    texts = [" ".join(words(r, 90)) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", texts[2].replace("w1", "v1"), None, "", "password: hunter22secret " + texts[5][:30]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = p.one_of_each_group(spark, at, str(tmp_path))
    want = brute_components([(i, t) for i, t in enumerate(texts)], 5, 80)
    assert kept.columns == p.COLUMNS and {x.doc_id for x in kept.collect()} == {i for i, (_, c) in enumerate(want) if c == i}
    twice = p.one_of_each_group(spark, at.union(at), str(tmp_path))
    assert Counter(x.doc_id for x in twice.collect()) == Counter(x.doc_id for x in kept.collect())
    cut = {x.doc_id: x for x in p.without_repeated_passages(spark, at, str(tmp_path)).collect()}
    for i, (t, w) in enumerate(zip(texts, brute_removed(texts))):
        assert len((cut[i].text or "").encode()) == w[0] - w[1] and cut[i].n_chars == len(cut[i].text or "")
    clean = {x.doc_id: x.text for x in p.without_secrets(spark, at, str(tmp_path)).collect()}
    assert clean[45].startswith("[assign] ") and clean[3] == texts[3]
    assert p.run(spark, str(tmp_path)).count() > 0


def plain_cut(texts):
    """The texts without the bytes that repeated strings of 200 bytes cover."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    gone = [{k for i in range(len(x) - 199) if count[x[i : i + 200]] > 1 for k in range(i, i + 200)} for x in raw]
    return [bytes(b for k, b in enumerate(x) if k not in g).decode() for x, g in zip(raw, gone)]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_texts import plain_toxicity

    r = random.Random(21)
    passage = " ".join(words(r, 70))
    texts = [" ".join([*words(r, 90), *(["nitwit"] if i % 6 == 0 else [])]) for i in range(60)]
    texts += [texts[1], texts[2].upper(), texts[3] + " end", texts[7] + " " + passage, passage + " " + texts[8], None, "", "", "Password: hunter22secret " + texts[9][:99], " ".join(words(r, 3000, 9000))]
    docs = {100 - i: t for i, t in enumerate(texts)}
    labels = {d: int("nitwit" in (t or "")) for d, t in docs.items() if d > 45}
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, k) for d, k in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    scores = plain_toxicity(docs, labels)
    left = sorted((d, t) for d, t in docs.items() if scores[d] < 0.5)
    assert 45 < len(left) < 62
    left = [(d, t) for (d, t), (_, c) in zip(left, brute_components(left, 5, 80)) if c == d]
    secret = re.compile("(?i)password: hunter22secret")
    left = {d: secret.sub("[assign]", t) for (d, _), t in zip(left, plain_cut([t for _, t in left]))}
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in left.items()}

    found = sorted(p.run(spark, str(tmp_path)).collect(), key=lambda x: (x.doc_id, x.piece))
    assert {x.doc_id for x in found} == set(ids)
    for d, own in ids.items():
        parts = [x for x in found if x.doc_id == d]
        assert [x.start for x in parts] == np.cumsum([0, *[x.length for x in parts[:-1]]]).tolist() and sum(x.length for x in parts) == len(own)
        assert [x.ids_crc32 for x in parts] == [zlib.crc32(np.array(own[x.start : x.start + x.length], "<u4").tobytes()) for x in parts]
    held = {}
    for x in sorted(found, key=lambda x: x.offset):
        assert x.offset == held.get(x.sequence_id, 0)
        held[x.sequence_id] = x.offset + x.length
    assert max(held.values()) <= 2048 and len(held) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("knobs", [{}, {"RANGE_ROWS": 7, "GROUP_RUNS": 2, "SHARD_BYTES": 600, "MAX_BROADCAST_KEYS": 0}, {"SPLIT": 2, "RANGE_ROWS": 50, "GROUP_RUNS": 3, "SEGMENT": 900, "SHARD_BYTES": 1500}])
def test_repeats_across_shards(spark, knobs, monkeypatch):
    """Many copies in many shards, texts of one repeated character, texts that hashes could mix up; also with tiny shards, ranges and groups."""
    for name, value in knobs.items():
        monkeypatch.setattr(suffix, name, value)
    r = random.Random(11)
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "x" * 1000, "y" * 150, "z" * 200]
    common = [" ".join(words(r, 70)) for _ in range(4)]
    for i in range(40):
        own = words(r, r.randrange(120))
        texts.append(" ".join([*own, *(common[i % 4].split()[r.randrange(8) :] if i % 3 else []), *words(r, 20)]))
    texts += [texts[20]] * 12 + [None] * 3 + [""] * 2
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    out = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = brute_removed([t for _, t in rows])
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out) == Counter((d, *w) for (d, _), w in zip(rows, want))


def test_in_two():
    r = random.Random(2)
    for k in (1, 2, 3, 8, 13):
        runs = [np.unique(np.array([b"%02d" % r.randrange(60) for _ in range(20)])) for _ in range(k)]
        count = Counter(x for run in runs for x in run.tolist())
        assert suffix.in_two(runs).tolist() == sorted(x for x, n in count.items() if n > 1)
