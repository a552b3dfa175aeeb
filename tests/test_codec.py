import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loglattice.functions.codec import KERNELS, UNPACK, decode_ints, encode_ints
from loglattice.operators.archive import decode_column, encode_column

ints = st.lists(st.integers(-(2**62), 2**62), max_size=60)


@settings(max_examples=150, deadline=None)
@given(ints, st.sampled_from(["zigzag", "positive", "text"]))
def test_integers_come_back(values, mode):
    assert decode_ints(encode_ints(np.array(values, np.int64), mode), mode).tolist() == values


def test_extreme_integers():
    v = [-(2**63), 2**63 - 1, 0, 4294967296]
    for mode in ("zigzag", "positive"):
        assert decode_ints(encode_ints(np.array(v, np.int64), mode), mode).tolist() == v


texts = st.lists(st.one_of(st.from_regex(r"\A[0-9]{1,20}\Z"), st.from_regex(r"\A-?[0-9]{1,4}\Z"), st.from_regex(r"\A/?[0-9.:/]{0,9}\Z"), st.text(max_size=6)), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(texts, st.booleans())
def test_columns_come_back(values, split):
    assert decode_column(*encode_column(values, split)) == values


def test_named_column_cases():
    for values in (["/10.0.0.1:80", "/10.0.0.2:81"], ["a::b", "c::d"], ["007", "012"], ["+5", "5"], ["x"] * 50, ["5"], ["9223372036854775807", "1"], ["", ""], ["a\0b", "c"]):
        assert decode_column(*encode_column(values)) == values


def test_kernels():
    for name, pack in KERNELS.items():
        assert UNPACK[name](pack(b"some text " * 99)) == b"some text " * 99
