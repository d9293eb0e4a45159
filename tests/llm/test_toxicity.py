import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oligoframe.llm import toxicity as X
from oligoframe.llm.kernel import view


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    sizes = np.array([4, 1, 6])
    first = np.array([0, 4, 5])
    e, moves = r.normal(0, 2, 11), np.array([-1.0, -0.5, 0.3, 0.8])
    p, z, _ = X.marginals(e, first, sizes, moves, pairs=True)
    for a, n in zip(first, sizes):
        weight = {}
        for tags in itertools.product((0, 1), repeat=n):
            s = sum(e[a + i] for i in range(n) if tags[i]) + moves[0] * tags[0]
            s += sum({(0, 0): 0, (0, 1): moves[1], (1, 0): moves[2], (1, 1): moves[3]}[t] for t in zip(tags, tags[1:]))
            weight[tags] = np.exp(s)
        total = sum(weight.values())
        assert np.allclose(p[a : a + n], [sum(w for t, w in weight.items() if t[i]) / total for i in range(n)])
    assert np.allclose(sorted(z)[-1], max(z))


@pytest.fixture(scope="module")
def sample():
    r = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["vilelout", "vilelink", "nasty"]))
        docs.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return docs, labels


def test_held_out_accuracy_and_spans(sample):
    docs, labels = sample
    model = X.Model().fit(docs[:400], labels[:400])
    data, off = view(pa.array(docs[400:]))
    score, spans = model.score(data, off)
    assert np.mean((score >= 0.5) == np.array(labels[400:], bool)) > 0.98
    for text, found in zip(docs[400:], spans, strict=True):
        assert all(text[s["start"] : s["end"]].split()[0] in ("vilelout", "vilelink", "nasty") for s in found)


def test_copies_do_not_make_words_toxic(sample):
    docs, labels = sample
    copied = docs[:400] + ["rareword " + docs[0] for _ in range(60)]
    model = X.Model().fit(copied, labels[:400] + [1] * 60)
    data, off = view(pa.array(["rareword is here with word1 and word2"]))
    assert model.score(data, off)[0][0] < 0.5


def test_operator(spark, odd, sample):
    model = X.Model().fit(*sample)
    got = X.toxicity(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert X.toxicity(odd.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity(odd, X.fit(odd, none)).count() == 11
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (4, 1)], "doc_id long, toxic int")
    assert X.toxicity(odd, X.fit(odd, labels)).count() == 11
