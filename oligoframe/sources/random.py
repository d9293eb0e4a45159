"""Reproducible random sequences: bases come from digests of a seed and a row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Filter
from ..functions.sequence import derive, passes


def raw_stream(spark: SparkSession, start: int, stop: int, length: int, seed: str) -> DataFrame:
    """(id, seq) of the rows start..stop-1 of the stream of a seed."""
    return spark.range(start, stop).select("id", derive(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), length).alias("seq"))


def candidates(spark: SparkSession, start: int, stop: int, length: int, f: Filter, seed: str) -> DataFrame:
    """The stream's rows that pass the composition checks, each string under its smallest id."""
    good = raw_stream(spark, start, stop, length, seed).filter(passes(F.col("seq"), f))
    return good.groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq")


def random_list(spark: SparkSession, count: int, lengths: list[int], seed: str = "0") -> DataFrame:
    """(id, seq): count unchecked sequences, each of one of the lengths; repeats may occur."""
    if count <= 0:
        raise ValueError(f"count must be positive, not {count}")
    if not lengths or min(lengths) <= 0:
        raise ValueError("lengths must be positive")
    if count > sum(4**n for n in set(lengths)):
        raise ValueError("count exceeds the number of different sequences of these lengths")
    ident = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    which = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("length:"), ident).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(len(lengths)))
    size = F.element_at(F.array(*map(F.lit, lengths)), (which + 1).cast("int"))
    return spark.range(count).select("id", F.substring(derive(ident, max(lengths)), F.lit(1), size).alias("seq"))
