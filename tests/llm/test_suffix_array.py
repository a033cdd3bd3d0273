import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from neo.llm import suffix_array as SA
from neo.llm.suffix_array import suffix_array, suffix_arrays


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_equals_sorted_suffixes(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_periodic_and_long():
    for s in ([1] * 3000, [1, 2] * 1500, [2, 1, 2] * 700):
        order = suffix_array(s)
        assert sorted(order) == list(range(len(s)))
        assert all(s[a:] < s[b:] for a, b in zip(order[:400], order[1:400]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=30))
def test_many_texts_side_by_side(texts):
    least, SA.LEAST_LANES = SA.LEAST_LANES, 1
    try:
        got = suffix_arrays([np.array(t, np.int16) for t in texts])
    finally:
        SA.LEAST_LANES = least
    assert [g.tolist() for g in got] == [suffix_array(t) for t in texts]
