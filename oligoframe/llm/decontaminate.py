"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A record of the join is a window of ``k`` consecutive item words (an item of fewer words is one window) and it must be
contained whole, so by the prefix principle one token of it is enough: its rarest word. Rarity is the word's document
frequency over all documents. A document word that equals a prefix token at offset ``o`` proposes one window start, which
must leave ``k`` words inside the document (length and position bound); the window's hash is then looked up and the words
themselves are compared, so no hash collision gets through.

The items are cut into blocks of bounded size; what a pass broadcasts is ``blocks_per_pass`` blocks at most, further blocks
take further passes. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import WORDY, Words, groups, view, window_hash
from .rows import column, extend
from .scratch import cut, small_batches, table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes(range(0x41, 0x5B))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
COLUMNS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_words", T.BinaryType())]
)


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_TO_LOWER))


def _hashes(words: list[bytes]) -> np.ndarray:
    w = Words(*view(pa.array(words, pa.binary())), np.ones(256, bool), lower=False)
    return w.hashes()


class Block:
    """Index of some items: windows by hash, and of each prefix token the offsets at which windows hold it."""

    def __init__(self, items: list[tuple[object, str | None]], k: int):
        self.k = k
        self.ids: list[str] = []
        self.words: list[list[bytes]] = []
        for ident, text in items:
            words = item_words(text)
            if words and ident is not None:
                self.ids.append(str(ident))
                self.words.append(words)
        self.vocabulary = np.unique(np.concatenate([_hashes(sorted({x for w in self.words for x in w})), np.zeros(0, np.uint64)])) if self.words else np.zeros(0, np.uint64)

    def build(self, frequency: dict[int, int]) -> Block:
        """frequency: documents that hold each word of the vocabulary."""
        self.by_length: dict[int, dict] = {}
        for i, words in enumerate(self.words):
            h, n = _hashes(words), min(self.k, len(words))
            rare = np.array([frequency.get(int(x), 0) for x in h])
            here = self.by_length.setdefault(n, {"windows": {}, "tokens": {}})
            for at, key in enumerate(window_hash(h, n).tolist()):
                known = here["windows"].setdefault(key, [])
                if any(self.words[j][b : b + n] == words[at : at + n] for j, b, _ in known):
                    next(x for x in known if self.words[x[0]][x[1] : x[1] + n] == words[at : at + n])[2].add(i)
                    continue
                known.append((i, at, {i}))
                o = min(range(n), key=lambda j: (rare[at + j], int(h[at + j])))
                token = int(h[at + o])
                here["tokens"][token] = here["tokens"].get(token, 0) | 1 << o
        for here in self.by_length.values():
            tokens = sorted(here["tokens"])
            here["masks"] = np.array([here["tokens"][t] for t in tokens], np.int64)
            here["tokens"] = np.array(tokens, np.uint64)
            here["keys"] = np.array(sorted(here["windows"]), np.uint64)
        return self

    def find(self, w: Words, h: np.ndarray, row: np.ndarray):
        """(start word, length, numbers of the items) of every occurrence."""
        for n, here in self.by_length.items():
            at, which = members(here["tokens"], h)
            starts = [at[(here["masks"][which] >> o) & 1 == 1] - o for o in range(n)]
            starts = np.unique(np.concatenate(starts))
            starts = starts[(starts >= 0) & (starts + n <= len(h))]
            starts = starts[row[starts] == row[starts + n - 1]]
            if not len(starts):
                continue
            key = window_hash_at(h, starts, n)
            hit, _ = members(here["keys"], key)
            for s, x in zip(starts[hit].tolist(), key[hit].tolist(), strict=True):
                words = [w.data[a:b].tobytes() for a, b in zip(w.start[s : s + n], w.end[s : s + n], strict=True)]
                for i, b, items in here["windows"][x]:
                    if self.words[i][b : b + n] == words:
                        yield s, n, items


def members(table_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of x's values that the sorted table holds, and where it holds them."""
    if not len(table_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coarse = np.zeros(1 << 18, bool)
    coarse[table_ >> np.uint64(46)] = True
    near = np.flatnonzero(coarse[x >> np.uint64(46)])
    place = np.minimum(np.searchsorted(table_, x[near]), len(table_) - 1)
    same = table_[place] == x[near]
    return near[same], place[same]


def window_hash_at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return window_hash(h[starts[:, None] + np.arange(n)].ravel(), n)[::n] if len(starts) else np.zeros(0, np.uint64)


def item_blocks(items: DataFrame, k: int, block_bytes: int) -> list[Block]:
    """The items in blocks of about block_bytes of text, read block by block; a longer item is a block of its own."""
    blocks, rows, size = [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_bytes:
            blocks.append(Block(rows, k))
            rows, size = [], 0
    return [*blocks, *([Block(rows, k)] if rows else [])]


def word_frequency(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Documents that hold each word of the vocabulary, counted over all documents; summed in each task before the shuffle."""
    if not len(vocabulary):
        return {}
    spark = docs.sparkSession
    small_batches(spark)
    words = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        v = words.value
        total = np.zeros(len(v), np.int64)
        for b in batches:
            data, off = view(b.column(0))
            for a, z in groups(off):
                w = Words(data[off[a] : off[z]], off[a : z + 1] - off[a], WORDY)
                at, which = members(v, w.hashes())
                seen = np.unique(w.row_of()[at] * len(v) + which)
                total += np.bincount(seen % len(v), minlength=len(v))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r[0] & 0xFFFFFFFFFFFFFFFF: r[1] for r in counts.collect()}


def contamination(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 1 << 21, blocks_per_pass: int = 4, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of an item window), item_ids (sorted as strings) and hit_words (bit per word).

    Null or empty text: no words, no hits. Items without words and items whose id is null join nothing. Repeated documents
    or items each count as themselves. Columns of docs named like a new one are replaced.
    """
    spark = docs.sparkSession
    blocks = item_blocks(items, k, block_bytes)
    vocabulary = np.unique(np.concatenate([b.vocabulary for b in blocks])) if blocks else np.zeros(0, np.uint64)
    chunk = 1 << 20  # words of a vocabulary that one counting pass looks for
    frequency: dict[int, int] = {}
    for i in range(0, len(vocabulary), chunk):
        frequency |= word_frequency(docs, vocabulary[i : i + chunk])
    passes = [[b.build(frequency) for b in blocks[i : i + blocks_per_pass]] for i in range(0, len(blocks), blocks_per_pass)] or [[]]
    out = docs
    for i, some in enumerate(passes):
        index = spark.sparkContext.broadcast(some)
        last = i == len(passes) - 1
        out = extend(out, COLUMNS, _finder(index, i > 0), drop if last else ())
        out = out if last else cut(out)
    return out


def _finder(index, again: bool) -> Callable:
    def make():
        blocks = index.value

        def row(b: pa.RecordBatch) -> list:
            data, off = view(column(b, "text"))
            n_words, n_hit, ids, bits = [], [], [], []
            for a, z in groups(off):
                w = Words(data[off[a] : off[z]], off[a : z + 1] - off[a], WORDY)
                h, of = w.hashes(), w.row_of()
                cover = np.zeros(len(w) + 1, np.int64)
                found: dict[int, set[str]] = {}
                for block in blocks:
                    for s, n, items in block.find(w, h, of):
                        cover[s] += 1
                        cover[s + n] -= 1
                        found.setdefault(int(of[s]), set()).update(block.ids[i] for i in items)
                hit = np.cumsum(cover[:-1]) > 0
                for r in range(z - a):
                    mine = hit[w.rows[r] : w.rows[r + 1]]
                    names = found.get(r, set())
                    if again:
                        mine = mine | np.unpackbits(np.frombuffer(column(b, "hit_words")[a + r].as_py(), np.uint8), count=len(mine)).astype(bool)
                        names = names | set(column(b, "item_ids")[a + r].as_py())
                    n_words.append(len(mine))
                    n_hit.append(int(mine.sum()))
                    ids.append(sorted(names))
                    bits.append(np.packbits(mine).tobytes())
            return [n_words, n_hit, ids, bits]

        return row

    return make


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark passage of 10 words, and the items concerned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark passage."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").drop(*COLUMNS.fieldNames())
