"""Greedy selection in parallel rounds, with the result of a sequential scan in order of id.

A row is taken if no earlier row that was taken conflicts with it: the lexicographically first independent set. In a round,
rows without an earlier undecided neighbour are taken and their later neighbours dropped. Rows without conflicts never enter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import ball
from ..lineage import cut, release
from .similarity import anti_join, lengths, self_join

#: Conflicts that the driver finishes by itself.
RESIDUE = 100_000
#: Strings settled at first where they crowd: with more conflicts each than CROWDED, were they spread evenly.
CHUNK, CROWDED = 30_000, 4


def rejected(conflicts: DataFrame, residue: int = RESIDUE) -> DataFrame:
    """Ids that a scan in order of id leaves out. conflicts: (i, j) with i < j, each once."""
    spark = conflicts.sparkSession
    edges = cut(conflicts.select("i", "j"))
    ident = edges.schema["i"].dataType.simpleString()
    parts: list[DataFrame] = []
    while True:
        if (few := edges.limit(residue + 1)).count() <= residue:
            out: set = set()
            for i, j in sorted((r[0], r[1]) for r in few.collect()):
                if i not in out:
                    out.add(j)
            parts.append(spark.createDataFrame([(x,) for x in sorted(out)], f"id {ident}"))
            break
        taken = edges.select(F.col("i").alias("id")).distinct().join(edges.select(F.col("j").alias("id")).distinct(), "id", "left_anti")
        gone = cut(edges.join(taken.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct())
        parts.append(gone)
        left = edges.join(taken.withColumnRenamed("id", "i"), "i", "left_anti").join(gone.withColumnRenamed("id", "i"), "i", "left_anti").join(gone.withColumnRenamed("id", "j"), "j", "left_anti")
        before, edges = edges, cut(left.select("i", "j"))
        release(before)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def greedy_select(df: DataFrame, d: int, needed: int | None = None, strategy: str = "auto", chunk: int = CHUNK) -> DataFrame:
    """Rows of df (id, seq, any others) that a greedy scan by id takes; the first ``needed`` of them if given.

    Of repeated strings only the first can be taken. Where strings crowd their space, the first ``chunk`` of them are settled, what
    lies near a taken one goes, and twice as many follow: the conflicts of those that go are never written. The first
    ``needed`` need no more chunks than it takes to find them.
    """
    first = cut(dedup_candidates(df))
    low, high, n = lengths(first)
    if n <= chunk or low != high or needed is None and n * ball(high, d - 1) <= CROWDED * 4**high:
        kept = first.join(rejected(self_join(first, d, strategy, (low, high, n))), "id", "left_anti").select("id")
    else:
        left, parts, found = first, [], 0
        while n:
            head = cut(left.orderBy("id").limit(chunk))
            parts.append(cut(head.join(rejected(self_join(head, d, strategy)), "id", "left_anti").select("id", "seq")))
            found += parts[-1].count()
            if n <= chunk or needed is not None and found >= needed:
                break
            last = head.agg(F.max("id")).first()[0]
            before, left = left, cut(anti_join(left.filter(F.col("id") > last), parts[-1], d))
            release(head, *([before] if before is not first else []))
            n, chunk = left.count(), 2 * chunk
        kept = reduce(DataFrame.unionAll, parts)
    kept = (first if set(df.columns) == {"id", "seq"} else df).join(kept.select("id"), "id", "left_semi").select(*df.columns)
    return kept.orderBy("id").limit(needed) if needed is not None else kept


def dedup_candidates(df: DataFrame) -> DataFrame:
    """(id, seq): each string once, under its smallest id."""
    return df.groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq")
