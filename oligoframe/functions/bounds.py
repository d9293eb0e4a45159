"""Bounds on the size of a code of n bases at distance d, in exact integers."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession


def ball(n: int, radius: int) -> int:
    """Strings within a Hamming radius of one."""
    return sum(comb(n, i) * 3**i for i in range(radius + 1))


def hamming_bound(n: int, d: int) -> int:
    """No code is larger."""
    return 4**n // ball(n, (d - 1) // 2)


def gv_bound(n: int, d: int) -> int:
    """A code of this size exists (Gilbert-Varshamov)."""
    return 4**n // ball(n, d - 1)


def bounds_table(spark: SparkSession, lengths: range, distances: range) -> DataFrame:
    """(n, d, gv, hamming); decimal, for numbers beyond 64 bits."""
    from decimal import Decimal

    rows = [(n, d, Decimal(gv_bound(n, d)), Decimal(hamming_bound(n, d))) for n in lengths for d in distances]
    return spark.createDataFrame(rows, "n int, d int, gv decimal(38,0), hamming decimal(38,0)")
