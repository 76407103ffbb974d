import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import words as W
from tabloom.llm.passages import compact_windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé \t\n\x0b\x0c\rñ漢", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(2, 30))
def test_words_are_those_of_the_pattern(texts, size):
    W.SLICE, old = size, W.SLICE
    try:
        data, offsets = W.buffers(pa.array(texts, pa.string()))
        hashes, starts, ends, bounds = W.word_hashes(data, offsets)
    finally:
        W.SLICE = old
    seen = {}
    for i, text in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        mine = range(bounds[i], bounds[i + 1])
        assert [bytes(data[starts[k] : ends[k]]).decode() for k in mine] == want
        for k, w in zip(mine, want):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            assert seen.setdefault(low, hashes[k]) == hashes[k]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=5), st.integers(1, 4), st.randoms())
def test_shingles(sizes, width, rnd):
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    words = np.array([rnd.randint(1, 3) for _ in range(bounds[-1])], np.uint64)
    got, got_bounds = W.shingles(words, bounds, width)
    by_value = {}
    for i in range(len(sizes)):
        row = words[bounds[i] : bounds[i + 1]].tolist()
        want = [tuple(row[j : j + width]) for j in range(len(row) - width + 1)]
        mine = got[got_bounds[i] : got_bounds[i + 1]].tolist()
        assert len(mine) == len(want)
        for m, w in zip(mine, want):
            assert by_value.setdefault(w, m) == m
    assert len(set(by_value.values())) == len(by_value)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 25), min_size=1, max_size=5), st.integers(2, 8), st.integers(2, 60), st.randoms())
def test_compact_windows(sizes, least, values, rnd):
    """Each run of ``least`` or more hashes lies in one window with its smallest hash, and windows are maximal."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    h = np.array([rnd.randint(1, values) for _ in range(bounds[-1])], np.uint64)
    got = list(zip(*(x.tolist() for x in compact_windows(h, bounds, least))))
    want = set()
    for r in range(len(sizes)):
        for c in range(bounds[r], bounds[r + 1]):
            left = right = c
            while left > bounds[r] and h[left - 1] >= h[c]:
                left -= 1
            while right < bounds[r + 1] - 1 and h[right + 1] >= h[c]:
                right += 1
            if right - left + 1 >= least:
                want.add((r, left, right, int(h[c])))
    assert {(r, a, b, v) for r, a, _, b, v in got} == want and len(got) == len(want)
    assert all(h[c] == v and (h[a:c] > v).all() for _, a, c, _, v in got)
