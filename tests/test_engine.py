import pytest
from pyspark.sql import functions as F

from loglattice.functions import similarity as S
from loglattice.operators import archive, cluster, headers, matcher, order, profile, templates, windows
from loglattice.sources import artifacts, formats
from loglattice.sources.lines import assemble_records, read_lines

LINES = [
    "Jan 10 host app: start id=7 from 10.0.0.1:80",
    "Jan  1 host app: start id=8 from 10.0.0.2:81",
    "Jan  2 host app: start id=007 from /a::b",
    "Jan  2 host app: stop, code=-1",
    "Jan  2 host app: stop, code=12",
    "",
    "   padded  ",
    "x <*> y z <*> w",
    "Jan  3 host app: a||b id=3",
    "nul \0 byte in it",
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(0, i, line) for i, line in enumerate(LINES)], "block_id long, rec_no long, line string").cache()


def learned(log, head=3):
    content = log.withColumn("line", F.regexp_replace("line", f"^(?:[^ \\t|]+[ \\t|]+){{{head}}}", ""))
    return templates.templates_of(content)


def test_round_trip_is_exact(spark, log):
    rows = learned(log).collect()
    t = spark.createDataFrame(rows, learned(log).schema)
    for kernel in ("lzma", "none"):
        encoded, failed = archive.compressed(log, t, 3, kernel)
        back = archive.restored(encoded, failed, t)
        assert sorted(map(tuple, back.drop("src").collect())) == sorted(map(tuple, log.select("block_id", "rec_no", "line").collect()))


def test_round_trip_without_templates(spark, log):
    t = learned(log).filter("false")
    encoded, failed = archive.compressed(log, t, 3)
    assert failed.count() == len(LINES)
    assert archive.restored(encoded, failed, t).count() == len(LINES)


def test_failures_and_unmatched(spark, log):
    t = learned(log).filter("support > 1")
    parsed = {r.rec_no: (r.eid, r.fail_reason) for r in matcher.matched(log, t, 3).collect()}
    assert parsed[5] == (-1, "empty") and parsed[9] == (-1, "bad_char") and parsed[6] == (-1, "wrong_format")
    assert parsed[0][0] > 0 and parsed[8][0] == 0


def test_first_template_wins_and_wildcard_matches_anything(spark):
    t = spark.createDataFrame([(1, ["<*>", " ", "b"], 3, [0], 1, ""), (2, ["a", " ", "<*>"], 3, [2], 1, "")], "eid int, tokens array<string>, n_tokens int, slots array<int>, support long, text string")
    rows = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "x y")], "rec_no long, line string")
    assert {r.rec_no: (r.eid, r.vars) for r in matcher.matched(rows, t).collect()} == {0: (1, ["a"]), 1: (2, ["c"]), 2: (0, None)}


def test_tree_trainer_merges():
    trainer = templates.TreeTrainer()
    for line in ("we open file a", "we open file b", "close it"):
        trainer.add([x for w in line.split(" ") for x in (w, " ")][:-1])
    assert sorted((("".join(c.tokens)), c.support) for c in trainer.clusters) == [("close it", 1), ("we open file <*>", 2)]
    assert "close it" in trainer.show()


def test_tree_trainer_merges_short_lines_in_their_last_token():
    trainer = templates.TreeTrainer()
    for line in ("user alice", "user bob", "x", "y", "a\tb c", "a\tb d", "a  b", "a\tb"):
        trainer.add([x for x in __import__("re").split(r"(\s+)", line)])
    assert sorted("".join(c.tokens) for c in trainer.clusters) == sorted(["a  b", "a\tb", "a\tb <*>", "user <*>", "x", "y"])


def test_too_many_templates_are_refused(spark, tmp_path):
    lines = spark.range(1001).select(F.concat(F.lit("word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("line"), F.col("id").alias("rec_no"))
    found = templates.templates_of(lines)
    for use in (lambda: templates.bounded(found), lambda: matcher.matched(lines, found), lambda: artifacts.write_templates(found, str(tmp_path / "t"))):
        with pytest.raises(ValueError, match="more than 1000"):
            use()
    assert templates.bounded(templates.templates_of(lines.filter("rec_no < 1000"))).count() == 1000


def test_folded_templates_match_every_member():
    import random

    assert S.folded_template([list("aXb"), list("aYb"), list("ab")]) == ["a", "<*>", "b"]
    for seed in range(300):
        r = random.Random(seed)
        rows = [[r.choice("abcd") for _ in range(r.randint(1, 7))] for _ in range(r.randint(1, 5))]
        template = S.folded_template(rows)
        assert all(S.gap_match(template, row) is not None for row in rows), rows
        assert all(not (x == y == "<*>") for x, y in zip(template, template[1:]))


def test_header_layout(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02d} {'INFO' if i % 2 else 'WARN'} rest") for i in range(50)], "rec_no long, line string")
    values = headers.header_values(rows, 2)
    assert {r.field: r.format for r in headers.formats(values).collect()} == {0: "%d-%d-%d"}
    assert {(r.field, r.delim) for r in headers.modal_delimiters(values).collect()} == {(0, " "), (1, " ")}


def test_multiline(spark):
    rows = spark.createDataFrame([("f", 0, "lost"), ("f", 1, "[1] head"), ("f", 2, "more"), ("f", 3, "[2] last")], "src string, rec_no long, line string")
    out = {r.rec_no: (r.raw, r.no_head) for r in assemble_records(rows, r"\[").collect()}
    assert out == {0: ("lost", True), 1: ("[1] head\nmore", False), 3: ("[2] last", False)}


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n two \n\nthree\n")
    (tmp_path / "b.log").write_bytes("caf\xe9\nx".encode("latin-1"))
    assert [r.line for r in read_lines(spark, str(tmp_path / "a.log")).orderBy("rec_no").collect()] == ["one", " two ", "", "three"]
    assert [r.line for r in read_lines(spark, str(tmp_path / "b.log"), "ISO-8859-1").orderBy("rec_no").collect()] == ["café", "x"]


def test_windows(spark):
    for n in (3, 8, 10):
        ids = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % 3 + 1).alias("eid"))
        out = [r.seq for r in windows.count_windows(ids, 4).orderBy("win_id").collect()]
        flat = [x for s in out for x in s]
        assert len(out) == -(-n // 4) and [x for x in flat if x != -1] == [i % 3 + 1 for i in range(n)]


def test_positions_match_a_global_rank(spark):
    keys = [5, 900, -3, 77, 10**12, 6]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert {r.k: r.pos for r in order.with_position(df, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    assert order.with_position(df.filter("false"), "k").count() == 0
    ends = [None, -(2**63), 2**63 - 1, *range(50)]
    wide = spark.createDataFrame([(k,) for k in ends], "k long")
    for cells in (1, 2, 7, 2048):
        assert {r.k: r.pos for r in order.with_position(wide, "k", cells=cells).collect()} == {k: i for i, k in enumerate([None, *sorted(ends[1:])])}


def test_chunk_sample_keeps_whole_chunks(spark):
    lines = spark.range(2000).select(F.col("id").alias("rec_no"), F.lit("x").alias("line"))
    out = order.chunk_sample(lines, 0.001, "s", least=5)
    assert out.count() == 100 and {r.n for r in out.groupBy(F.floor(F.col("rec_no") / 20)).agg(F.count("*").alias("n")).collect()} == {20}


def test_profile_rules(spark):
    rows = [("V", 1, 0, i, str(1000 + i)) for i in range(40)] + [("V", 1, 1, i, "ab"[i % 2]) for i in range(40)] + [("V", 1, 2, i, f"{i:03d}") for i in range(40)] + [("V", 1, 3, i, f"k{i}") for i in range(40)]
    cols = spark.createDataFrame(rows, "scope string, eid int, col int, pos long, value string")
    assert {r.col: r.kind for r in profile.encoding_plan(cols).collect()} == {0: "delta", 1: "dictionary", 2: "fixed", 3: "string"}
    assert profile.string_lcs("a.b:c", "x.y:z/") == ".:"


def test_pattern_split_round_trip(spark):
    df = spark.createDataFrame([("/10.0.0.1:80",), ("a::b.c.d.",), ("",)], "v string")
    parts = df.select("v", profile.split_pattern(F.col("v"), ".:").alias("p"))
    assert parts.filter("v like '/%'").select(profile.joined_pattern(F.col("p"), ".:").alias("r")).first().r == "/10.0.0.1:80".replace("10.0.0.1:80", "10.0.0.1:80")


def test_header_sample_is_by_position(spark):
    rows = spark.range(4_000, 12_000).select(F.col("id").alias("rec_no"), F.when(F.col("id") < 6_000, F.lit("noheader")).otherwise(F.concat(F.lit("a"), F.col("id") % 10, F.when(F.col("id") < 11_000, F.lit(" ")).otherwise(F.lit("\t")), F.lit("text"))).alias("line"))
    values = headers.header_values(rows, 1)
    assert values.agg(F.count("*"), F.min("rec_no"), F.max("rec_no")).first() == (5_000, 6_000, 10_999)
    mode = headers.part_mode(values).first()
    assert (mode.field, mode.n_parts, mode.total, mode.formatted) == (0, 2, 5_000, True)
    assert [(r.piece, r.length) for r in headers.layout(values).orderBy("part").collect()] == [("a", 0), ("%d", 1)]


def test_linkage_and_iterative_clusters(spark):
    points = [(i, [float(i % 3 * 10), float(i % 2) / 10]) for i in range(60)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    labels = {r.id: r.cluster for r in cluster.complete_linkage(df, "id", "v", 1.0).collect()}
    assert len(set(labels.values())) == 3 and all((labels[i] == labels[j]) == (i % 3 == j % 3) for i in labels for j in labels)
    out = {r.id: r.cluster for r in cluster.iterative_clusters(df, "id", "v", 1.0, rate=0.5).collect()}
    assert len(out) == 60 and -1 not in out.values()
    assert len(cluster.farthest_first(df, "id", "v", 3)) == 3


def test_iterative_clusters_outlast_fruitless_rounds(spark):
    # one group of 10 among 290 lone points: most samples of 30 hold fewer than three of the group
    points = [(i, [0.0, i / 1000]) for i in range(10)] + [(i, [100.0 * i, 0.0]) for i in range(10, 300)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    labels = {k: cluster.iterative_clusters(df, "id", "v", 1.0, seed=k).collect() for k in ("0", "4")}
    for out in labels.values():
        found = {r.id: r.cluster for r in out}
        assert len(out) == len(found) == 300
        assert len({found[i] for i in range(10)}) == 1 and found[0] >= 0 and all(found[i] == -1 for i in range(10, 300))


def test_similarities(spark):
    assert S.lcs(list("abcde"), list("axcye")) == (3, ["a", "<*>", "c", "<*>", "e"])
    assert S.gap_match(["a", "<*>", "c"], ["a", "b", "b", "c"]) == [["b", "b"]]
    assert S.gap_match(["a", "<*>", "c"], ["a", "b"]) is None
    assert S.folded_template([list("abc"), list("adc")]) == ["a", "<*>", "c"]
    row = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"], "kitten", "sitting", [0.0, 3.0], [4.0, 0.0])], "a array<string>, b array<string>, s string, t string, x array<double>, y array<double>")
    got = row.select(S.ngram_distance(F.col("a"), F.col("b"), 2), S.jaccard_distance(F.col("a"), F.col("b")), S.edit_distance(F.col("s"), F.col("t")), S.euclidean(F.col("x"), F.col("y")), S.lcs_distance(F.col("a"), F.col("b")), S.multiset_cosine_distance(F.col("a"), F.col("b")), S.entropy_distance("s", "s"), S.ratcliff_distance("s", "t")).first()
    assert [round(v, 4) for v in got] == [0.5, 0.5, 0.4286, 2.5, 0.3333, 0.3333, 0.0, round(1 - 8 / 13, 4)]


def test_formats(spark):
    df = spark.createDataFrame([("081109 203615 148 INFO dfs.DataNode: Received block blk_1 of 10.0.0.1:5",)], "line string")
    row = formats.parse_layout(df, formats.FORMATS["HDFS"][0]).first()
    assert (row.Date, row.Pid, row.Component, row.Content) == ("081109", "148", "dfs.DataNode", "Received block blk_1 of 10.0.0.1:5")
    assert df.select(formats.masked(F.lit("blk_-12 from 10.0.0.1:5"), "HDFS")).first()[0] == "<*> from <*>"
    assert formats.catalogue(spark).count() == 16


def test_a_block_is_restored_without_joins(spark, log):
    """the columns of a block are decoded and filled in one pass over the encoded rows."""
    t = spark.createDataFrame(learned(log).collect(), learned(log).schema)
    encoded, failed = archive.compressed(log, t, 3, "zstd")
    plan = archive.restored(encoded, failed, t)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_blocks_of_any_key_and_size_are_restored(spark, monkeypatch):
    """lines without a block number, several sources and blocks that are cut into slices; a missing template is an error, not a loss."""
    monkeypatch.setattr(archive, "SLICE", 7)
    made = [(src, b, i, f"d{i % 4}|\t h{i}  user u{i * 7} {'said' if i % 3 else 'left <*>'} {i:05d} é中") for src in ("x", "y") for b in (None, 0, 1) for i in range(40)]
    rows = spark.createDataFrame([*made, ("y", 1, 40, ""), ("y", 1, 41, None)], "src string, block_id long, rec_no long, line string")
    t = spark.createDataFrame(learned(rows, 2).collect(), artifacts.TEMPLATES)
    encoded, failed = archive.compressed(rows, t, 2, "zstd")
    assert failed.count() == 2
    assert sorted(map(str, archive.restored(encoded, failed, t).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="template .* is missing"):
        archive.restored(encoded, failed, t.filter("eid > 1")).collect()


def test_merged_templates_confirm_equal_hashes(spark, monkeypatch):
    """mining compares hashes first; tokens whose hashes clash stay apart."""
    monkeypatch.setattr(templates.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = spark.createDataFrame([("a 1 x7",), ("a 2 x7",), ("b 3",)], "line string")
    assert sorted((r.sig, r.token) for r in templates.merged_templates(rows).collect() if r.pos in (2, 4)) == [("a <*> <*>", "<*>"), ("a <*> <*>", "x7"), ("b <*>", "3")]
