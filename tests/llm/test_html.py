import numpy as np
from pyspark.sql import functions as F

from oligoframe.llm import html as H
from oligoframe.llm.html_samples import sample_pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies.</div><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First   line<br>goes <b>on</b>, and on, for a while.<p>Second &eacute; paragraph of the text, which says more.
<div class="ad">Buy this now.</div><ul><li>one item here<li>two items there</ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Great article, thanks!</p></div></section>
<form action="/s"><label>Search</label><input><button>Go</button></form><footer>&copy; me</footer></body></html>"""


def test_blocks():
    got = [b.text for b in H.blocks(PAGE)]
    assert "First line goes on, and on, for a while." in got and "Second é paragraph of the text, which says more." in got and "A & B" in got
    assert not any("var t" in t or "p{}" in t for t in got)
    assert H.blocks(None) == [] and H.blocks("") == [] and [b.text for b in H.blocks("plain <b>text")] == ["plain text"]
    assert [b.text for b in H.blocks("<p>a<!-- x <p> --> b<script>if (a<b) {")] == ["a b"]


def test_labels_of_pages_not_seen():
    model, right, total = H.trained(), 0, 0
    test = H.labelled(sample_pages(120, 99))
    for (_, y), p in zip(test, model.label([x for x, _ in test]), strict=True):
        right, total = right + int(((p >= 0.5) == (y > 0)).sum()), total + len(y)
    assert right / total > 0.97
    x, y = test[3]
    alone, together = model.label([x])[0], model.label([t[0] for t in test[:8]])[3]
    assert np.allclose(alone, together, atol=1e-5)


def test_operator(spark, words):
    long = "".join(f"<p>{words(3000, k)}.</p>" for k in range(12))
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1>{long}</article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r for r in H.main_text(df).collect()}
    assert got[1]["text"].startswith("A & B\n\nFirst line") and "Great article" not in got[1]["text"] and "Home" not in got[1]["text"] and "cookies" not in got[1]["text"]
    assert got[2]["text"] == got[3]["text"] == ""
    assert got[4]["text"] == "\n\n".join(["Head", *(words(3000, k) + "." for k in range(12))])
    assert H.main_text(df.limit(0)).count() == 0
