import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from oligoframe.llm import kernel as K
from oligoframe.llm.bwt import Collection


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né,.9"))))
def test_words_equal_a_regular_expression(rows):
    data, off = K.view(pa.array(rows, pa.string()))
    w = K.Words(data, off, K.NOT_SPACE)
    upper = bytes(range(65, 91))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (r or "").encode().translate(bytes.maketrans(upper, upper.lower()))) for r in rows]
    got = [[w.data[a:b].tobytes() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.rows, w.rows[1:])]
    assert got == want
    by_hash = {}
    for word, h in zip(sum(want, []), w.hashes().tolist(), strict=True):
        assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
    s, at = K.shingles(w.hashes(), w.rows, 3)
    assert np.diff(at).tolist() == [max(len(x) - 2, min(1, len(x))) for x in want]


def test_sliced_arrays_and_groups():
    col = pa.array(["abc", None, "", "de f", "g" * 50])
    data, off = K.view(col.slice(1))
    assert off.tolist() == [0, 0, 0, 4, 54] and data[:4].tobytes() == b"de f"
    assert list(K.groups(off, 10)) == [(0, 3), (3, 4)]
    assert K.view(pa.array([], pa.string()))[1].tolist() == [0]


def test_transform_finds_shared_substrings():
    r = random.Random(1)
    for _ in range(60):
        strings = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 9))]
        k = r.randint(1, 6)
        seen = {}
        for s in strings:
            for i in range(len(s) - k + 1):
                seen[s[i : i + k]] = seen.get(s[i : i + k], 0) + 1
        want = [[i for i in range(len(s) - k + 1) if seen[s[i : i + k]] > 1] for s in strings]
        assert [sorted(x) for x in Collection(strings).shared(k)] == want
