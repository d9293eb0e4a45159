import random
import re

import numpy as np
import pytest

from oligoframe.llm import jaccard as J


def plain(rows):
    """Components by comparing all pairs."""
    up = bytes(range(65, 91))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(up, up.lower())))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.fixture
def rows(words):
    """Copies, chains of edits, a shared passage in many texts, short texts."""
    r = random.Random(3)
    out, passage = [], words(120, 77)
    for k in range(60):
        out.append(words(r.randint(1, 60), k, 60))
    for k in range(30):
        out.append(passage + " " + words(r.randint(1, 40), 500 + k))
    text = words(150, 9).split()
    for k in range(40):
        text[r.randrange(len(text))] = f"edit{k}"
        out.append(" ".join(text))
    base = words(200, 10).split()
    for k in range(30):
        mine = list(base)
        for _ in range(r.randint(0, 9)):
            mine[r.randrange(len(mine))] = f"w{k}x{r.random()}"
        out.append(" ".join(mine))
    out += [out[5]] * 4 + [out[100].upper(), "a b c", "A  b\tc", "a", "", None]
    r.shuffle(out)
    return [(1000 - 3 * k, t) for k, t in enumerate(out)]


def test_components_equal_all_pairs(table, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.groups_of(table(rows)).collect()}
    assert got == plain(rows)


def test_components_without_rarity_or_first_step(table, rows, monkeypatch):
    """The result doesn't depend on what is called hot, nor on which sets the first step finds."""
    want = plain(rows)
    for name, value in (("HOT", 1), ("HOT", 10**9), ("LEAST_LOW", 1), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(J, name, value)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.groups_of(table(rows)).collect()}
        assert got == want
        monkeypatch.undo()


def test_list_pairs_keep_all_that_may_link():
    r = np.random.default_rng(4)
    n = np.sort(r.integers(5, 200, 300))
    rest = np.maximum(1, n - r.integers(0, 30, 300))
    root = r.integers(0, 40, 300)
    got = {(int(a), int(b)) for x, y in J.list_pairs(n, rest, root) for a, b in zip(x, y)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if root[i] != root[j] and 185 * min(rest[i], rest[j]) >= 85 * (n[i] + n[j]) and 100 * n[i] >= 85 * n[j]}
    assert got == want


def test_odd_rows(odd, table, spark):
    got = J.groups_of(odd).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[1] == {1} and by[2] == {2} and by[3] == {3} and by[9] == {8} and by[None] == {None} and by[4] == {4}
    assert J.groups_of(table([])).count() == 0
    kept = J.stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 10]


def test_long_lists_in_blocks_of_few(table, rows, monkeypatch):
    """Lists that are dealt out in small blocks give the same pairs as lists that are worked off in their task."""
    monkeypatch.setattr(J, "LONG", 1)
    monkeypatch.setattr(J, "DEALT", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.groups_of(table(rows)).collect()}
    assert got == plain(rows)


def test_one_group_around_the_threshold(table, words, monkeypatch):
    """Edited copies of one text whose similarities to one another lie on both sides of the threshold."""
    r = random.Random(12)
    base = words(240, 21, 3000).split()
    rows = []
    for k in range(400):
        w = list(base)
        for j in r.sample(range(len(w)), r.randint(2, 6)):
            w[j] = f"e{k}x{j}"
        rows.append((k, " ".join(w)))
    want = plain(rows)
    assert len({c for _, c in want.values()}) > 1
    monkeypatch.setattr(J, "LONG", 50)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.groups_of(table(rows)).collect()} == want


def test_ids_of_text_and_clashing_columns(spark, words):
    text = words(60, 4)
    rows = [("b", text, 1, 2), ("a", text, 3, 4), ("c", words(60, 5), 5, 6), (None, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, Ident long, key long")
    assert {r["doc_id"]: r["component_id"] for r in J.groups_of(docs).collect()} == {"a": "a", "b": "a", "c": "c", None: None}
    kept = J.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {"a", "c", None}
