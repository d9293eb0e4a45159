import duckdb
import pytest
from pyspark.sql import functions as F

from oligoframe.llm import mixing as M


def water(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in capped]
        room = total - sum(capped.values())
        target = {k: room * weight[k] / sum(weight[x] for x in free) for k in free}
        above = [k for k in free if target[k] > most * sizes[k]]
        if not above:
            return capped | target
        capped |= {k: most * sizes[k] for k in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 1000, None: 5}, {"a": 1}, {"b": 0, "c": 7}, {str(i): i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix(table, words):
    docs = table([(i, words(1 + i % 37, i)) for i in range(900)])
    got = M.mix(docs).collect()
    sums = {}
    for r in got:
        t = sums.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] and r["size"] == len(r["text"].split())
    assert all(abs(a - b) <= 20 for a, b in sums.values())
    again = {r["doc_id"]: r["taken"] for r in M.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert {r["doc_id"]: r["taken"] for r in M.mix(docs, seed="other").collect()} != again


def test_sql(table, words, tmp_path):
    docs = table([(i, words(1 + i % 23, i)) for i in range(300)])
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, source_size, copies, taken from ({M.OP6_SQL})").fetchall()}
    assert {r["doc_id"]: (r["size"], r["source_size"], r["copies"], r["taken"]) for r in M.mix(docs).collect()} == want


def test_longer_texts_are_likelier(table, words):
    """Inclusion probabilities differ within a source, and the shares taken follow them."""
    docs = table([(i, words(8 if i % 2 else 128, i)) for i in range(1500)])
    got = M.mix(docs, share=0.5).collect()
    share = {n: sum(r["copies"] for r in got if r["size"] == n) / sum(r["size"] == n for r in got) for n in (8, 128)}
    assert share[128] / share[8] == pytest.approx(2, rel=0.2)  # (128 / 8) ** LEAN
    even = M.mix(docs, share=0.5, lean=0.0).collect()
    share = {n: sum(r["copies"] for r in even if r["size"] == n) / sum(r["size"] == n for r in even) for n in (8, 128)}
    assert share[128] / share[8] == pytest.approx(1, rel=0.2)


def test_clashing_columns(table, words):
    docs = table([(i, words(20, i)) for i in range(30)])
    more = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("p", "certain", "last_rank", "_source", "origin", "Kind", "found", "class"))))
    got = M.mix(more)
    assert got.columns[: len(more.columns)] == more.columns and {r["p"] for r in got.collect()} == {0}
    assert {r["doc_id"]: r["taken"] for r in got.collect()} == {r["doc_id"]: r["taken"] for r in M.mix(docs).collect()}


def test_odd_rows(odd, table, spark):
    got = M.mix(odd.withColumn("target", F.lit("old"))).collect()
    assert len(got) == 11 and all(r["taken"] == 0 for r in got if not (r["text"] or "").strip()) and all(r["copies"] <= 2 for r in got)
    assert M.mix(table([])).count() == 0 and M.mix(table([(1, None), (2, "")])).count() == 2
    assert "Python" not in M.mix(odd)._jdf.queryExecution().toString()
