import random
from collections import Counter

import numpy as np
import pytest

from oligoframe.llm import substrings as S


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum())
        out.append((len(d), int(gone.sum()), edges, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


@pytest.fixture
def texts(words):
    r = random.Random(6)
    passages = [words(60, k) for k in range(5)]
    out = []
    for k in range(50):
        t = words(r.randint(0, 90), 300 + k)
        for p in r.sample(passages, r.randint(0, 3)):
            a = r.randrange(len(p) // 2)
            t = t[: r.randint(0, len(t))] + p[a : a + r.randint(40, len(p))] + t[r.randint(0, len(t)) :]
        out.append(t)
    return [*out, out[3], out[3], "ab" * 400, "z" * 500, "é😀" * 60, "", None]


@pytest.mark.parametrize(("length", "hot"), [(400, 20_000), (80, 20_000), (80, 2), (80, 0)])
def test_equals_all_windows(table, texts, length, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.without_repeats(table(list(enumerate(texts))), length, hot).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, length)


def test_minima():
    r = np.random.default_rng(1)
    grams = r.integers(0, 50, 400).astype(np.uint64) << np.uint64(30)
    got = S.minima(grams, 37) & S._PLACE
    assert got.tolist() == [i + int(np.argmin(grams[i : i + 37])) for i in range(400 - 36)]


def test_odd_rows(odd, table):
    rows = S.without_repeats(odd).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in rows}
    assert len(rows) == 11 and got[1] == (0, 0) and got[8] == got[9] and got[8][0] == got[8][1] and got[7] == (30_000, 30_000)
    assert S.without_repeats(table([])).count() == 0


def test_clashing_columns_and_ids_of_text(spark, words):
    text = words(150, 4)
    docs = spark.createDataFrame([("a", text, 1, 2, 3, 4), ("b", text, 5, 6, 7, 8), (None, None, 9, 9, 9, 9)], "doc_id string, text string, ident long, KEY long, Ranges long, N_BYTES long")
    out = S.without_repeats(docs)
    assert out.columns == ["doc_id", "text", "ident", "KEY", "Ranges", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r["doc_id"]: (r["ident"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    n = len(text)
    assert got == {"a": (1, n, n, 1, b""), "b": (5, n, n, 1, b""), None: (9, 0, 0, 0, b"")}


def test_query_holds_the_contract(spark, table, texts, tmp_path):
    import hashlib

    table(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    out = S.op9_suffix_dedup(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = [(k, *x[:3], hashlib.sha256(x[3]).hexdigest()) for k, x in enumerate(plain(texts, 400))]
    assert sorted(tuple(r) for r in out.collect()) == want
