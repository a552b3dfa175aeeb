from pyspark.sql import functions as F

from loglattice.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_match_tokens_keep_every_delimiter(spark):
    line = "2024-01-01 00:00:07 INFO a: x=1, y=2"
    tokens = one(spark, X.match_tokens(F.lit(line)))
    assert "".join(tokens) == line
    assert one(spark, X.match_tokens(F.lit("a  b"))) == ["a", " ", " ", "b"]


def test_training_tokens_keep_runs_and_wildcards(spark):
    assert one(spark, X.training_tokens(F.lit("a  b:<*>c"))) == ["a", "  ", "b", ":", "<*>", "c"]


def test_head_and_content_are_exact(spark):
    line = "Jan  1 host: it ran"
    assert one(spark, X.head_of(F.lit(line), 2)) == "Jan  1 "
    assert one(spark, X.content_of(F.lit(line), 2)) == "host: it ran"
    assert one(spark, X.head_of(F.lit("short"), 2)) == ""


def test_integers_are_canonical(spark):
    for value, ok in {"0": True, "-7": True, "007": False, "+5": False, "-0": False, "": False, "1.5": False, "9223372036854775807": False, "922337203685477580": True}.items():
        assert one(spark, X.is_integer(F.lit(value))) is ok


def test_padding_never_cuts(spark):
    assert one(spark, X.zero_padded(F.lit("7"), F.lit(3))) == "007"
    assert one(spark, X.zero_padded(F.lit("12345"), F.lit(3))) == "12345"
    assert one(spark, X.zero_padded(F.lit("7"), F.lit(-1))) == "7"


def test_number_forms(spark):
    for n in (0, 1, -1, 63, 64, -64, -65, 2**31, -(2**40)):
        z = one(spark, X.zigzag(F.lit(n).cast("long")))
        assert z == (2 * n if n >= 0 else -2 * n - 1)
        assert one(spark, X.unzigzag(F.lit(z).cast("long"))) == n
        assert one(spark, X.varint_size(F.lit(z).cast("long"))) == max(1, -(-z.bit_length() // 7))
    assert bytes(one(spark, X.big_endian(F.lit(-2).cast("long")))) == b"\xff\xff\xff\xfe"


def test_masks_and_signature(spark):
    assert one(spark, X.masked_numbers(F.array(*map(F.lit, ["12", "10.0.0.1:80", "a1"])))) == ["<*>", "<*>", "a1"]
    assert one(spark, X.signature(F.lit("/10.0.0.1:80"))) == "/...:"
    assert one(spark, X.collapsed_wildcards(F.lit("a<*><*>b"))) == "a<*>b"
    assert one(spark, X.transposed(F.array(*map(F.lit, ["abc", "de"])))) == "adbec"
    assert one(spark, X.fits_format(F.lit("2024-01"), "%d-%d")) and not one(spark, X.fits_format(F.lit("2024/01"), "%d-%d"))
