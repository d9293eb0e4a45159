import hashlib

import pytest

from oligoframe.llm import fingerprint as P


def test_edits_change_few_chunks(words):
    a = words(3000, 1).encode()
    b = a[:5000] + b"some words put in" + a[5000:]
    x, y = P.chunk([a, b])
    assert P.likeness(x, y) > 0.9 and P.likeness(x, P.chunk([words(3000, 2).encode()])[0]) < 0.05
    assert (P.chunk([b"", a, a])[1] == P.chunk([a])[0]).all() and int(x["bytes"].sum()) == len(a)
    assert P.compare(P.text_of(x), P.text_of(y)) == P.likeness(x, y)
    assert P.likeness(*P.chunk([b"", b""])) == 1.0 and P.likeness(*P.chunk([b"", b"a"])) == 0.0


def test_gear_equals_its_definition():
    import numpy as np

    data = np.frombuffer(b"some bytes that roll through the window of the hash" * 3, np.uint8)
    h = 0
    for t, v in enumerate(P.gear(data).tolist()):
        h = (h << 1) + int(P._GEAR[data[t]]) & 0xFFFFFFFF
        assert v == h or t >= P.WINDOW and v == sum(int(P._GEAR[data[t - i]]) << i for i in range(P.WINDOW)) & 0xFFFFFFFF


@pytest.mark.parametrize("n", [1, 2, 57])
def test_next_document(table, words, n):
    rows = [(i * 7 % 101, words(5 + i * 3, i) + "é😀") for i in range(n)]
    got = {r["doc_id"]: r for r in P.fingerprints(table(rows)).collect()}
    rows.sort()
    for k, (i, t) in enumerate(rows):
        follows = rows[(k + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        own, new, after = P.chunk([t.encode(), edited.encode(), follows.encode()])
        assert got[i]["fingerprint"] == P.text_of(own) and got[i]["near_edited"] == P.likeness(own, new) and got[i]["near_next"] == P.likeness(own, after)


def test_odd_rows(odd, table):
    got = P.fingerprints(odd).collect()
    assert len(got) == 11 and sum(r["fingerprint"] == "" for r in got) == 2
    assert P.fingerprints(table([])).count() == 0
