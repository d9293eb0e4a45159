"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (each step shifts left and adds the byte's random word, so 32 bytes decide a value of
32 bits; the sum is built by doubling, over a whole batch at once). A chunk ends where the top bits are zero: more bits are
asked for before the normal size than after it, within a smallest and a largest size. The fingerprint is the sorted list of
distinct chunk digests with the bytes that each covers, as hex. Boundaries follow the content, so an edit changes the chunks
it touches and those beside them only.

To read each document beside the next one by id, rows are dealt into ranges of ids whose bounds come from quantiles; the
first document of a range is also sent to the range before it (that of the first range to the last one), and each task
streams its sorted rows with one row of lookahead.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Ranges, mix
from .scratch import small_batches, table

SMALLEST, NORMAL, LARGEST = 32, 128, 512
HARD_BITS, EASY_BITS, WINDOW = 9, 5, 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ENTRY = np.dtype([("digest", ">u8"), ("bytes", ">u4")])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the WINDOW bytes that end at each byte."""
    h, step = _GEAR[data], 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    return h


def chunk(texts: list[bytes]) -> list[np.ndarray]:
    """The fingerprint of each text: distinct chunk digests in ascending order with the bytes they cover."""
    sizes = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear(data)
    # The first bytes of a text don't see the text before it: no boundary is nearer than SMALLEST = WINDOW bytes to its start.
    hard = (np.flatnonzero(h >> np.uint32(32 - HARD_BITS) == 0) + 1).tolist()
    easy = (np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0) + 1).tolist()
    n_hard, n_easy, cuts, rows = len(hard), len(easy), [], [0]
    for at, end in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        while at < end:
            if end - at <= SMALLEST:
                to = end
            else:
                i = bisect_left(hard, at + SMALLEST)
                if i < n_hard and hard[i] < at + NORMAL:
                    to = hard[i]
                else:
                    i = bisect_left(easy, at + NORMAL)
                    to = easy[i] if i < n_easy and easy[i] < at + LARGEST else at + LARGEST
                to = min(to, end)
            cuts.append(to)
            at = to
        rows.append(len(cuts))
    ends = np.array(cuts, np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    digest = Ranges(data).range_hash(starts, ends) if len(ends) else np.zeros(0, np.uint64)
    length = ends - starts
    # Distinct digests of all texts at once: sort by text, then digest.
    row = np.repeat(np.arange(len(texts)), np.diff(rows))
    order = np.lexsort((digest, row))
    digest, row, length = digest[order], row[order], length[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(first), _ENTRY)
    out["digest"] = digest[first]
    out["bytes"] = np.add.reduceat(length, first) if len(first) else 0
    return np.split(out, np.searchsorted(row[first], np.arange(1, len(texts)))) if texts else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes in common chunks over the larger of the two sizes; two empty fingerprints are alike."""
    total = max(int(a["bytes"].sum()), int(b["bytes"].sum()))
    if not total:
        return 1.0
    x, y = a["digest"].astype(np.uint64), b["digest"].astype(np.uint64)
    if not len(x) or not len(y):
        return 0.0
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[place] == x
    return float(np.minimum(a["bytes"][same].astype(np.int64), b["bytes"][place[same]].astype(np.int64)).sum()) / total


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.tobytes().hex()


def compare(fingerprint: str, other: str) -> float:
    """Likeness of two fingerprints given as text."""
    return likeness(*(np.frombuffer(bytes.fromhex(x), _ENTRY) for x in (fingerprint, other)))


def beside_next(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, text): rows of each bucket in order of id, each bucket's last row (tail) being the one that follows it.

    Null ids come last; equal ids are taken in order of their texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    width = max(1, round(len(bounds) ** 0.5))
    coarse = bounds[::width] or [0]
    fine = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[0]]

    def below(array, x):
        return F.size(F.filter(array, lambda y: y <= x))

    ident = F.col("doc_id")
    coarse_at = below(F.array(*map(F.lit, coarse)), ident)
    fine_at = F.when(coarse_at > 0, below(F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in fine)), F.greatest(coarse_at, F.lit(1))), ident)).otherwise(0)
    bucket = F.when(ident.isNull(), F.lit(len(bounds) + 1)).otherwise(F.when(coarse_at > 0, (coarse_at - 1) * width + fine_at).otherwise(0)).cast("int")
    firsts = sorted((r[0], r[1]) for r in docs.select("doc_id").groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text")
    target = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    known = [(k, v) for k, v in target.items() if k is not None]
    to = spark.createDataFrame(known or [(None, 0)], "doc_id long, bucket int")
    tails = docs.join(F.broadcast(to), "doc_id").select("bucket", F.lit(1).alias("tail"), "doc_id", "text")  # a row for each bucket
    if None in target:
        tails = tails.union(docs.filter(ident.isNull()).select(F.lit(target[None]), F.lit(1), "doc_id", "text"))
    return docs.select(bucket.alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text").union(tails).repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame, group_bytes: int = 1 << 20) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    The edited text has the last half of the code points replaced by the first as many of the next document. Null text is
    empty; an empty text has the empty fingerprint. Repeated rows each give a row. Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        held: tuple | None = None
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            if held is not None:
                rows.insert(0, held)
            at = 0
            while at < len(rows) - 1:
                end, size = at, 0
                while end < len(rows) - 1 and (size < group_bytes or end == at):
                    size += len(rows[end][3])
                    end += 1
                if out := block(rows[at : end + 1]):
                    yield out
                at = end
            held = rows[-1] if rows else held

    def block(rows):
        """Results of all but the last row."""
        todo = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        if not todo:
            return None
        edited = []
        for i in todo:
            text, follows = rows[i][3], rows[i + 1][3]
            half = len(text) // 2
            edited.append((text[: len(text) - half] + follows[:half]).encode())
        prints = chunk([r[3].encode() for r in rows] + edited)
        own, new = prints[: len(rows)], prints[len(rows) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in todo], pa.int64()),
                pa.array([len(rows[i][3]) for i in todo], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                pa.array([text_of(own[i]) for i in todo]),
                pa.array([text_of(x) for x in new]),
                pa.array([likeness(own[i], x) for i, x in zip(todo, new, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in todo], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return beside_next(docs).mapInArrow(run, SCHEMA)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text mixed with the next one's."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
