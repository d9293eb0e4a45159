import random

import pytest

from oligoframe.llm import decontaminate as D


def plain(docs, items, k=10):
    windows = {}
    for i, t in items:
        w = D.item_words(t)
        n = min(k, len(w))
        if i is not None:
            for j in range(len(w) - n + 1 if w else 0):
                windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = D.item_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if got := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize(("block_bytes", "blocks_per_pass"), [(1 << 21, 4), (200, 1), (200, 3)])
def test_equals_all_windows(spark, table, words, block_bytes, blocks_per_pass):
    r = random.Random(1)
    items = [(i, words(r.randint(1, 40), i, 50)) for i in range(12)] + [(20, None), (21, ""), (22, "the the the"), (None, words(30, 5))]
    docs = []
    for i in range(60):
        t = words(r.randint(0, 80), 900 + i, 50)
        if i % 3 == 0:
            w = (r.choice(items[:12])[1]).split()
            a = r.randrange(len(w))
            t += "\n" + " ".join(w[a : a + 15]).upper() + "; " + words(5, i)
        docs.append((i, t))
    got = D.contamination(table(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, blocks_per_pass=blocks_per_pass).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == plain(docs, items)


def test_odd_rows(spark, odd, table):
    items = spark.createDataFrame([(1, "two words"), (2, "no id here at all said the text")], "item_id long, text string")
    got = D.contamination(odd, items).collect()
    assert len(got) == 11 and sum(r["n_hit"] > 0 for r in got) == 2
    assert D.contamination(table([]), items).count() == 0
    assert D.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0
