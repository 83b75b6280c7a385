import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnmap.llm import tokens


def words(text):
    return (text or "").encode().lower().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0cabcABC é漢.", max_size=40)), max_size=8), st.integers(1, 9))
def test_words_are_those_of_bytes_split(texts, block):
    before, tokens.BLOCK = tokens.BLOCK, block
    try:
        h, offs = tokens.word_hashes(pa.array(texts, pa.string()))
    finally:
        tokens.BLOCK = before
    want = [words(t) for t in texts]
    assert np.diff(offs).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    names = dict(zip(flat, h.tolist()))
    assert all(names[w] == x for w, x in zip(flat, h.tolist())) and len(set(names.values())) == len(names)


def test_slices_of_arrays_keep_their_place():
    a = pa.array(["x y", None, "Z q", "w"])
    h, offs = tokens.word_hashes(a)
    part, at = tokens.word_hashes(a.slice(2, 2))
    assert np.array_equal(part, h[offs[2] :]) and at.tolist() == [0, 2, 3]


def test_shingles():
    h, offs = tokens.word_hashes(pa.array(["a b a b", "a", "", "a b"]))
    sets = tokens.shingle_sets(h, offs, 2)
    assert [len(s) for s in sets] == [2, 1, 0, 1] and sets[3][0] in sets[0]
    assert [len(s) for s in tokens.shingle_sets(h, offs, 5)] == [1, 1, 0, 1]


def test_slices_bound_bytes():
    assert list(tokens.slices(np.array([3, 3, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert list(tokens.slices(np.array([], int))) == []
