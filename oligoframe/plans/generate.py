"""Growth of a library: candidates in order of a reproducible stream, against the pool, then against one another.

A candidate is accepted if no accepted row of smaller id, and no seed, is nearer than the least distance. That depends on the
order of the stream only, so the chunks in which it is worked off do not change the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Filter
from ..functions.bounds import gv_bound, hamming_bound
from ..lineage import cut
from ..operators.selection import greedy_select
from ..operators.similarity import anti_join
from ..sources.random import candidates


@dataclass
class Library:
    """sequences: id (place), role (seed or new), seq. complete: whether the count was reached. rounds: (looked at, accepted) of each chunk."""

    sequences: DataFrame
    complete: bool
    rounds: list[tuple[int, int]]


def check_arguments(count: int, length: int, f: Filter, seeds: int = 0, seed_lengths: tuple[int, int] | None = None, paired: bool = False, strict: bool = True) -> list[str]:
    """Raises ValueError for what can't be met; returns warnings. strict: the homopolymer limit must be below the length."""
    if length <= 0:
        raise ValueError(f"length must be positive, not {length}")
    if count <= 0:
        raise ValueError(f"count must be positive, not {count}")
    if strict and f.homopolymer_max >= length:
        raise ValueError("homopolymer_max must be less than the length")
    longest = max(length, seed_lengths[1] if seed_lengths else 0)
    if f.min_distance >= longest:
        raise ValueError(f"min_distance must be less than the longest length {longest}")
    said = [f"length {length} is above 20: slower than needed"] if length > 20 else []
    if seed_lengths is None or seed_lengths == (length, length):
        total = count * (2 if paired else 1) + seeds
        if total > hamming_bound(length, f.min_distance):
            raise ValueError(f"{total} sequences exceed the Hamming bound {hamming_bound(length, f.min_distance)}")
        if total > gv_bound(length, f.min_distance):
            said.append(f"{total} sequences exceed the Gilbert-Varshamov bound {gv_bound(length, f.min_distance)}; generation may not finish")
    return said


def generate(spark: SparkSession, count: int, length: int, f: Filter, seed: str = "0", seeds: DataFrame | None = None, paired: bool = False, chunk: int | None = None, empty_rounds: int = 3, stream: int | None = None) -> Library:
    """count sequences (twice as many if paired) besides the seeds (seq, and id for their order; they are not checked).

    Stops short after empty_rounds chunks without any acceptance. chunk: rows of the stream worked off at once. stream: rows
    that the stream has, endless if None; it stops short at its end too.
    """
    target = count * (2 if paired else 1)
    old = cut(seeds.select("id", "seq")) if seeds is not None else None
    n_old = old.count() if old is not None else 0
    pool, accepted, start, idle = [], 0, 0, 0
    rounds: list[tuple[int, int]] = []
    while accepted < target and idle < empty_rounds and (stream is None or start < stream):
        # The stream passes at about 0.4 and thins out as the space fills; what the last chunk gave tells how much to read.
        rate = max(0.01, rounds[-1][1] / rounds[-1][0]) if rounds else 0.3
        step = chunk or min(4_000_000, max(2_000, int((target - accepted) / rate * 1.15)))
        step = step if stream is None else min(step, stream - start)
        new = candidates(spark, start, start + step, length, f, seed)
        for side in ([old] if old is not None else []) + pool:
            new = anti_join(new, side.select("id", "seq"), f.min_distance)
        got = cut(greedy_select(cut(new), f.min_distance, None))
        n = got.count()
        rounds.append((step, n))
        start, accepted, idle = start + step, accepted + n, 0 if n else idle + 1
        if n:
            pool.append(got)
        if len(pool) > 4:
            pool = [cut(_union(pool))]
    fresh = _union(pool).orderBy("id").limit(target) if pool else None
    rows = [x.select(F.lit(k).alias("_part"), "id", F.lit(role).alias("role"), "seq") for k, (role, x) in enumerate((("seed", old), ("new", fresh))) if x is not None]
    if not rows:
        return Library(spark.createDataFrame([], "id long, role string, seq string"), False, rounds)
    from ..sources.text import number

    all_rows = number(_union(rows).withColumnRenamed("id", "_own"), "_part", "_own").select("id", "role", "seq")
    return Library(all_rows, accepted >= target, rounds)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_pairs(new: DataFrame, seed: str = "7") -> DataFrame:
    """new (seq) with pair_id from 0 and side: a fixed shuffle by digest, its halves set side by side."""
    from ..sources.text import number

    shuffled = number(new.select("seq", F.md5(F.concat(F.lit(f"{seed}:"), "seq").cast("binary")).alias("_digest")), "_digest", "seq").select("id", "seq")
    half = shuffled.count() // 2
    return shuffled.select(F.when(F.col("id") < half, F.col("id")).otherwise(F.col("id") - half).alias("pair_id"), F.when(F.col("id") < half, 1).otherwise(2).alias("side"), "seq")
