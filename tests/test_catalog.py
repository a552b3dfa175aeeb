import os

import pytest

from loglattice.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", ["template_counts", "token_topk", "header_layout", "header_part_mode", "modal_delimiter", "header_numbers", "dense_ids", "column_profile", "template_match", "slot_values", "load_failures", "multiline_records", "delta_rule", "dict_encode", "zigzag", "count_windows", "idf_weights", "restore_lines", "encoding_plan", "stream_template_counts", "lcs_distance", "mixed_distance", "ngram_similarity", "multiset_cosine", "entropy_distance", "euclidean_distance", "min_distance", "center_index", "window_rows", "gap_match", "collapsed_wildcards", "header_format_check", "big_endian", "transposed", "chunk_sample", "mixed_match", "restore_mixed", "line_ratio_score"])
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
