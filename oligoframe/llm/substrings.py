"""Exact repeated substrings over a corpus, by suffix order of short overlapping pieces.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as well. To find such strings without
one suffix array of the whole corpus, every window of ``length`` bytes is assigned to its minimiser: the GRAM-byte string in
it of the smallest hash, leftmost of equals. Equal windows have equal minimisers at equal offsets. Consecutive windows with
one minimiser form a piece of less than twice ``length`` bytes, so that all windows of the corpus lie in pieces, equal
windows in pieces of one minimiser, and a window occurs once in a piece.

1. Pieces are read without their bytes: minimiser, place, 128-bit digest. A minimiser of one piece repeats nothing. Equal
   pieces (digest) repeat whole, however many there are; they are counted in their tasks first.
2. Of minimisers with different pieces, one piece of each digest goes, with its bytes, to the task of its minimiser. There
   pieces that share no ANCHOR-byte string beside the minimiser with another are set aside (a shared window holds one),
   and the suffixes of the others are ordered by the column-wise construction in ``bwt``.
3. A minimiser with more than HOT different pieces is not held in one task: its windows are counted by digest instead.
4. Covered bytes are sent back to the documents that hold the pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import Collection
from .kernel import Ranges, groups, mix, trim, view
from .rows import column, extend
from .scratch import cut, fresh, release, small_batches, table

LENGTH, GRAM, ANCHORS, HOT, BATCH = 400, 16, 8, 20_000, 1 << 20
#: Bits of the filter that tells which minimisers have several different pieces; it lets through some others, which does no harm.
FILTER_BITS = 26
COLUMNS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    h, step = _BYTES[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(2 * step * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Of ``width`` consecutive gram hashes from each place, the smallest, leftmost of equals.

    40 bits of the hash are compared, then the place modulo 2**24, which the low bits of the result tell.
    """
    key = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64) & _PLACE
    n = -(-len(key) // width) * width
    full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: len(key) - width + 1], ahead[width - 1 : len(key)])


_PLACE = np.uint64((1 << 24) - 1)


class Pieces:
    """The pieces of all rows: row, start in the row, size, place of the minimiser in the piece, its hash, and digests."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        rows = np.flatnonzero(np.diff(off) >= length)
        if not len(rows):
            self.row = self.start = self.size = self.least = self.begin = self.end = np.zeros(0, np.int64)
            self.key = self.one = self.two = np.zeros(0, np.uint64)
            return
        low = minima(gram_hashes(data), length - GRAM + 1)
        new = np.ones(len(low) + 1, bool)
        np.not_equal(low[1:], low[:-1], out=new[1:-1])
        inside = np.zeros(len(low) + 1, bool)  # whether a window that starts here lies in its row
        for a, z in zip(off[rows].tolist(), (off[rows + 1] - length + 1).tolist(), strict=True):
            inside[a:z] = True
            new[a] = new[z] = True
        begin = np.flatnonzero(new & inside)
        new[:-1][~inside[:-1]] = True
        bounds = np.flatnonzero(new)
        end = bounds[np.searchsorted(bounds, begin) + 1] - 1 + length
        at = begin + (((low[begin] & _PLACE).astype(np.int64) - begin) & int(_PLACE))
        words = Ranges(data)
        self.row = np.searchsorted(off, begin, "right") - 1
        self.start, self.size, self.least, self.begin, self.end = begin - off[self.row], end - begin, at - begin, begin, end
        self.key = words.range_hash(at, at + GRAM)
        self.one = words.range_hash(begin, end)
        # A second digest of the same bytes under another mixing, with the minimiser's place in the piece.
        half = (begin + end) // 2
        self.two = mix(words.range_hash(begin, half) * np.uint64(0xD6E8FEB86659FD93) + words.range_hash(half, end) + self.least.astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def read_pieces(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, start, size, least, key, one, two) of every piece, without bytes."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "text_key", "start", "size", "least", "key", "one", "two"]

    def run(batches):
        for b in batches:
            data, off = view(b.column(2))
            for a, z in groups(off, 1 << 18):
                p = Pieces(data[off[a] : off[z]], off[a : z + 1] - off[a], length)
                of = pa.array(p.row + a)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(p.start), pa.array(p.size), pa.array(p.least), signed(p.key), signed(p.one), signed(p.two)], names=names)

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    ident = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {ident}, text_key long, start long, size long, least long, key long, one long, two long")


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, one, two, least, bytes) of the pieces whose minimiser passes a filter made from wanted's keys, each once a task."""
    spark = docs.sparkSession
    bits = wanted.select((F.pmod("key", F.lit(1 << FILTER_BITS)) + 1).alias("v"))
    # At most 2**FILTER_BITS / 8 bytes (8 MB) in rows of 4 kB, however many keys there are.
    maps = bits.groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    flat = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in maps:
        flat[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(flat)

    def run(batches):
        table_ = shared.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            data, off = view(b.column(0))
            for a, z in groups(off, 1 << 18):
                part = data[off[a] : off[z]]
                p = Pieces(part, off[a : z + 1] - off[a], length)
                v = (p.key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                new = []
                for i in np.flatnonzero(table_[v // 8] >> (v % 8).astype(np.uint8) & 1).tolist():
                    digest = (int(p.one[i]), int(p.two[i]))
                    if digest in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()  # only spares repeated rows
                    seen.add(digest)
                    new.append(i)
                if new:
                    at = np.array(new)
                    yield pa.RecordBatch.from_arrays(
                        [signed(p.key[at]), signed(p.one[at]), signed(p.two[at]), pa.array(p.least[at]), pa.array([part[x:y].tobytes() for x, y in zip(p.begin[at].tolist(), p.end[at].tolist(), strict=True)], pa.binary())],
                        names=["key", "one", "two", "least", "bytes"],
                    )

    return docs.select("text").mapInArrow(run, "key long, one long, two long, least long, bytes binary")


def shared_windows(strings: list[bytes], least: list[int], length: int) -> list[list[int]]:
    """Of each piece, the starts of its windows that another piece holds; pieces of any minimisers."""
    out: list[list[int]] = [[] for _ in strings]
    some = anchored(strings, least, length)
    if some:
        parts = Collection([strings[i][a:z] for i, a, z in some]).shared(length)
        for (i, a, _), starts in zip(some, parts, strict=True):
            out[i] = [a + x for x in starts]
    return out


def anchored(strings: list[bytes], least: list[int], length: int) -> list[tuple[int, int, int]]:
    """Pieces that share an anchor with another one, and the range of each in which windows hold a shared anchor.

    Of a window's length - GRAM bytes beside the minimiser, for some j of ANCHORS at least j parts lie before it and
    ANCHORS - 1 - j parts behind it: with the minimiser they are the anchor j. Equal windows have an equal anchor.
    """
    part = (length - GRAM) // ANCHORS
    by: dict[tuple[int, bytes], list[int]] = {}
    for i, (s, m) in enumerate(zip(strings, least, strict=True)):
        for j in range(ANCHORS):
            a, z = m - part * j, m + GRAM + part * (ANCHORS - 1 - j)
            if a >= 0 and z <= len(s):
                by.setdefault((j, hashlib.blake2b(s[a:z], digest_size=12).digest()), []).append(i)
    found: dict[int, tuple[int, int]] = {}
    for (j, _), pieces in by.items():
        if len(pieces) > 1:
            for i in pieces:
                a, z = least[i] - part * j, least[i] + GRAM + part * (ANCHORS - 1 - j)
                lo, hi = found.get(i, (len(strings[i]), 0))
                found[i] = min(lo, max(0, z - length)), max(hi, min(len(strings[i]), a + length))
    return [(i, *found[i]) for i in sorted(found)]


def runs(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows at these starts."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + length
        else:
            out.append([s, s + length])
    return [(a, b) for a, b in out]


def compare(pieces: DataFrame, length: int) -> DataFrame:
    """(key, one, two, begin, finish): covered ranges of pieces that share windows with others of their minimiser."""
    rows = pieces.repartition("key").sortWithinPartitions("key", "one", "two")

    def run(batches):
        group: list[tuple] = []  # whole minimisers, at least BATCH bytes of them
        size = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if group and r[:3] == group[-1][:3]:
                    continue
                if group and r[0] != group[-1][0] and size > BATCH:
                    yield from solve(group)
                    group, size = [], 0
                    trim()
                group.append(r)
                size += len(r[4])
        yield from solve(group)
        trim()

    def solve(group):
        found = shared_windows([r[4] for r in group], [r[3] for r in group], length)
        out = [(*r[:3], a, z) for r, starts in zip(group, found, strict=True) if starts for a, z in runs(starts, length)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["key", "one", "two", "begin", "finish"])

    return rows.mapInArrow(run, "key long, one long, two long, begin long, finish long")


def count_windows(pieces: DataFrame, length: int) -> DataFrame:
    """As compare(), for minimisers with very many different pieces: every window is a row, counted in its task first."""

    def run(batches):
        for b in batches:
            data, off = view(b.column(4))
            for a, z in groups(off, 1 << 18):
                part, o = data[off[a] : off[z]], off[a : z + 1] - off[a]
                w = Ranges(part)
                many = np.diff(o) - length + 1
                of = np.repeat(np.arange(z - a), many)
                at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                s = o[of] + at
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(pa.array(of + a)) for i in range(3)), pa.array(at), signed(w.range_hash(s, s + length)), signed(w.range_hash(s, s + length // 2))], names=["key", "one", "two", "begin", "w1", "w2"]
                )

    windows = cut(pieces.dropDuplicates(["key", "one", "two"]).mapInArrow(run, "key long, one long, two long, begin long, w1 long, w2 long"))
    twice = windows.groupBy("key", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return windows.join(twice, ["key", "w1", "w2"]).select("key", "one", "two", "begin", (F.col("begin") + length).alias("finish"))


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, ranges): byte ranges that go, of each document that has any; ranges may overlap."""
    read = cut(read_pieces(docs, length))
    distinct = cut(read.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size")))
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1")
    per_key = cut(per_key)
    pieces = fetch(docs, per_key, length)
    hot_keys = per_key.filter(F.col("pieces") > hot)
    whole = distinct.filter("n > 1").select("key", "one", "two", F.lit(0).cast("long").alias("begin"), F.col("size").alias("finish"))
    if hot_keys.isEmpty():
        found = compare(pieces, length)
    else:
        pieces = cut(pieces)
        found = compare(pieces.join(hot_keys, "key", "left_anti"), length).union(count_windows(pieces.join(hot_keys, "key", "left_semi"), length))
    covered = cut(found.union(whole).groupBy("key", "one", "two").agg(F.collect_list(F.struct("begin", "finish")).alias("ranges")))
    back = read.select("doc_id", "text_key", "start", "key", "one", "two").join(covered, ["key", "one", "two"])
    spans = back.select("doc_id", "text_key", F.transform("ranges", lambda r: F.struct((r["begin"] + F.col("start")).alias("begin"), (r["finish"] + F.col("start")).alias("finish"))).alias("ranges"))
    out = cut(spans.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    release(read, distinct, per_key, covered)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay; a character may be cut).

    Null text is empty. Rows that repeat id and text count as places of their own. Columns of docs named like a new one are replaced.
    """
    ident, key, ranges = fresh(docs, "ident", "key", "ranges")
    lost = repeats(docs.select("doc_id", "text"), length, hot).select(F.col("doc_id").alias(ident), F.col("text_key").alias(key), F.col("ranges").alias(ranges))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    found = docs.drop(*COLUMNS.fieldNames()).join(lost, F.col("doc_id").eqNullSafe(F.col(ident)) & (own == F.col(key)), "left").drop(ident, key)

    def make():
        def row(b: pa.RecordBatch) -> list:
            data, off = view(column(b, "text"))
            n_removed, n_spans, kept = [], [], []
            for i, (begin, finish) in enumerate(merged(column(b, ranges))):
                stays = np.concatenate(([0], finish)), np.concatenate((begin, [off[i + 1] - off[i]]))
                n_removed.append(int((finish - begin).sum()))
                n_spans.append(len(begin))
                kept.append(b"".join(data[off[i] + a : off[i] + z].tobytes() for a, z in zip(*(x.tolist() for x in stays), strict=True)))
            return [np.diff(off), n_removed, n_spans, kept]

        return row

    return extend(found, COLUMNS, make, (ranges,))


def merged(col: pa.ListArray):
    """Per row of a column of (begin, finish), the starts and ends of the maximal runs that they cover, ascending."""
    off = col.offsets.to_numpy()
    first, last = (col.values.field(k).to_numpy() for k in (0, 1))
    for i in range(len(col)):
        begin, finish = first[off[i] : off[i + 1]], last[off[i] : off[i + 1]]
        order = np.argsort(begin, kind="stable")
        begin, finish = begin[order], np.maximum.accumulate(finish[order])
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > finish[:-1]
        yield begin[new], finish[np.concatenate((new[1:], [True]))] if len(new) else finish


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document before and after repeated strings of 400 bytes are removed, and a digest of what stays."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
