"""Properties that hold for any input, without Spark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortshift.llm import packing, simhash, suffix_dedup, token_files


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), max_size=12))
def test_plan_wastes_less_than_one_sequence(histogram):
    placed, n = packing.plan(histogram, 64)
    total = sum(k * v for k, v in histogram.items())
    assert n == -(-total // 64)
    assert sum((hi - lo) * length for rows in placed.values() for lo, hi, _, length, *_ in rows) == total


@settings(deadline=None, max_examples=40)
@given(st.text("ab ", min_size=1, max_size=300), st.integers(0, 50))
def test_equal_windows_have_equal_anchors(text, shift):
    raw = (text + "x" * shift + text).encode()
    length, gram = 20, 6
    if len(raw) < length:
        return
    anchor, start, n = suffix_dedup.runs(raw, length, gram)
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and n.sum() == len(raw) - length + 1
    owner = np.repeat(anchor, n)
    first = {}
    for i in range(len(raw) - length + 1):
        assert first.setdefault(raw[i : i + length], owner[i]) == owner[i]


@settings(deadline=None, max_examples=60)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_a_cell(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    pairs = lambda x: ((x >> 1 & x & simhash.PAIRS) << 1) | ((x >> 1 ^ x) & simhash.PAIRS)
    a, b = pairs(fp), pairs(other)
    half = lambda x, i: x >> 32 * i & simhash.HALF
    assert any(set(simhash.grid_cells(half(a, i))) & set(simhash.grid_cells(half(b, i))) for i in (0, 1))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 50_256), max_size=300), st.integers(16, 20), st.integers(1, 64))
def test_token_bytes_round_trip(ids, bits, block):
    x = np.array(ids, "<u4")
    f = token_files.TokenFile(token_files.to_bytes([1], [len(ids)], x, bits, block))
    assert f.document(0).tolist() == ids
