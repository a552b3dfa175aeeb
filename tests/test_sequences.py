from loglattice.operators import sequences


def test_sequence_templates(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(i, ["a", str(i % 5), "b"] if i % 2 else ["x", "y", str(i % 7), "z"], [float(i % 2) * 9]) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, seq array<string>, v array<double>")
    out, templates = sequences.sequence_templates(df, "id", "seq", "v", 1.0)
    assert sorted(templates) == [["a", "<*>", "b"], ["x", "y", "<*>", "z"]]
    assert all(templates[r.template][0] == ("a" if r.id % 2 else "x") for r in out.collect())
    parts = sequences.matched_sequences(df, "seq", [["a", "<*>", "b"]]).filter("id = 3").first()
    assert parts.template == 0 and parts.parts == [["3"]]


def test_adaptive_patterns():
    rows = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"], ["q", "r", "s", "t", "u"]]
    assert sequences.adaptive_patterns(rows) == [["a", "b", "c", "d", "<*>"], ["q", "r", "s", "t", "u"]]
