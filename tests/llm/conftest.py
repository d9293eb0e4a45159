import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """A documents table from (id, text) pairs; sources repeat s0, s1, null."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", (f"s{k % 3}" if k % 3 < 2 else None), len(t) if t is not None else None) for k, (i, t) in enumerate(pairs)], DOCS)

    return make


@pytest.fixture
def words():
    """Texts of random words."""
    import random

    def make(n, seed, vocabulary=400):
        r = random.Random(seed)
        v = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
        return " ".join(r.choice(v) for _ in range(n))

    return make


@pytest.fixture
def odd(table, words):
    """Nulls, empty texts, white space, repeated rows, equal ids, a very long word and a very long text."""
    long = words(20_000, 1)
    return table([(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (4, "two words"), (None, "no id here at all, said the text"), (7, "x" * 30_000), (8, long), (9, long), (10, "é😀 ü" * 50)])
