import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.common import Words, pieces

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("aB \n\té\x0b\x1c 漢Z."), max_size=20), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = Words(texts)
    want = [WORD.findall((t or "").encode().lower()) for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == flat
    by = {}
    for word, h in zip(flat, w.hash.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_hashes_do_not_depend_on_the_place():
    a = Words(["x" * 5000 + " same", "same"]).hash
    assert a[1] == a[2] and a[0] != a[1]
    words = [f"{i:x}" for i in range(200_000)]
    assert len(np.unique(Words([" ".join(words)]).hash)) == len(words)


def test_pieces():
    assert list(pieces([], 3)) == [] and list(pieces(["aa", None, "bbbb", "c"], 3)) == [(0, 2), (2, 3), (3, 4)]
