import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm.words import shingle_hashes, slices, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09éÉß日 \n.-_~", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    hashes, pointers = word_hashes(pa.array(texts, pa.string()))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(pointers).tolist() == [len(w) for w in want]
    names: dict[int, str] = {}
    for h, w in zip(hashes.tolist(), [w for ws in want for w in ws]):
        assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)


def test_long_words_and_sliced_arrays():
    texts = ["x" * 9000, "x" * 9001, "x" * 4096 + "y" + "x" * 4903, "X" * 9000, "a " * 700_000]
    hashes, pointers = word_hashes(pa.array(["zz", *texts]).slice(1))
    assert hashes[0] == hashes[3] and len(set(hashes[:3].tolist())) == 3
    assert pointers.tolist() == [0, 1, 2, 3, 4, 700_004]


def test_shingles():
    hashes, pointers = word_hashes(pa.array(["a b c d e f", "a b c d e", "a b", "", "b a"]))
    shingles, begin = shingle_hashes(hashes, pointers, 5)
    assert begin.tolist() == [0, 2, 3, 4, 4, 5]
    assert shingles[0] == shingles[2] and len(set(shingles.tolist())) == 4


def test_slices_cover_all_texts():
    pointers = np.array([0, 0, 5, 6, 100, 100, 101])
    assert [r for lo, hi in slices(pointers, 10) for r in range(lo, hi)] == list(range(6))
