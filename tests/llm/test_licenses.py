import textwrap

import pytest
from pyspark.sql import functions as F

from oligoframe.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    return L.Model().fit([f"plain words of line {i} that say this and that about the {i} things" for i in range(200)])


def test_families(model, table, words):
    rows = [(k, f"{words(20, k)}\n{t}\n{words(9, k + 50)}") for k, t in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    want = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    got = {r["doc_id"]: r for r in L.scan(table(rows), model).collect()}
    right = sum([x["family"] for x in got[k]["licenses"] if x["confirmed"]] == [f] for k, f in enumerate(want))
    assert right >= 0.95 * len(want)
    one = next(x for x in got[0]["licenses"] if x["confirmed"])
    assert one["paragraph"] == 1 and rows[0][1][one["start"] :].startswith("Licensed under the Apache")


def test_plain_text_has_none(model, table, words):
    rows = [(k, "\n".join(words(25, k * 10 + j) for j in range(8))) for k in range(40)] + [(100 + k, t) for k, t in enumerate(L.PLAIN)]
    assert sum(x["confirmed"] for r in L.scan(table(rows), model).collect() for x in r["licenses"]) == 0


def test_odd_rows(model, odd, table):
    got = L.scan(odd.withColumn("licenses", F.lit(1)), model).collect()
    assert len(got) == 11 and sum(r["n_paragraphs"] for r in got if not r["text"]) == 0
    assert L.scan(table([]), model).count() == 0 and L.scan(table([]), L.fit(table([]))).count() == 0


def confirmed(row):
    return [x["family"] for x in row["licenses"] if x["confirmed"]]


def test_wrapped_and_amid_a_long_line(model, table, words):
    """Notices broken into short lines, and notices in the middle of a line of 1000 words."""
    long = [(f, t) for f, ts in L.TEMPLATES.items() for t in ts if len(t.split()) >= 12]
    rows = [(k, words(30, k) + "\n\n" + "\n".join(textwrap.wrap(t, 60)) + "\n\n" + words(30, k + 90)) for k, (_, t) in enumerate(long)]
    rows += [(100 + k, words(500, k) + " " + t + " " + words(500, k + 90)) for k, (_, t) in enumerate(long)]
    got = {r["doc_id"]: confirmed(r) for r in L.scan(table(rows), model).collect()}
    want = {100 * j + k: [f] for k, (f, _) in enumerate(long) for j in (0, 1)}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_short_notices(model, table, words):
    rows = [(k, f"{words(20, k)}\n© 2019 {words(2, k + 50)}. All rights reserved.\n{words(9, k + 80)}") for k in range(40)]
    got = [confirmed(r) for r in L.scan(table(rows), model).collect()]
    assert sum(x == ["Proprietary"] for x in got) >= 0.9 * len(rows)
