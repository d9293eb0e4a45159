"""Validation of a sequence list: composition of every row, then distances between those that pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Filter, distance_method
from ..functions.sequence import PASSES, reasons
from ..lineage import cut
from ..operators.similarity import count_pairs, first_pair, first_violation, self_join
from ..sources.text import number


@dataclass
class ValidationResult:
    """violations: (ordinal from 1, seq, reason); pairs: (i, j, seq1, seq2, distance), places among the passing rows from 0.

    The pairs are worked out when they are read, and count_violations gives their number without them.
    """

    overall_valid: bool
    total_sequences: int
    biological_passed: int
    biological_failed: int
    biological_violations: DataFrame = field(repr=False)
    distance_skipped: bool
    distance_violation: tuple[int, int, str, str, int] | None
    validation_method: str
    features_checked: int
    distance_violations: DataFrame | None = field(default=None, repr=False)
    count_violations: Callable[[], int] | None = field(default=None, repr=False)


def composition(df: DataFrame, f: Filter) -> DataFrame:
    """df with reason: the failed checks, or the text for none."""
    return df.withColumn("reason", reasons(F.col("seq"), f))


def validate(sequences: DataFrame, f: Filter, skip_distance: bool = False) -> ValidationResult:
    """sequences: seq, and id if they have an order (else they are ordered by seq). Mixed lengths are found in the data.

    The first violating pair is that of the smallest place, then the smallest second place; repeats are at distance 0.
    """
    if "id" not in sequences.columns:
        sequences = number(sequences.select("seq"), "seq")
    judged = cut(composition(number(sequences.select(F.col("id").alias("_order"), "seq"), "_order").select("id", "seq"), f))
    counts = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == PASSES).alias("good"), *(g(F.when(F.col("reason") == PASSES, F.length("seq"))).alias(k) for g, k in ((F.min, "low"), (F.max, "high")))).first()
    n, good, low, high = counts["n"], counts["good"], counts["low"] or 0, counts["high"] or 0
    failed = judged.filter(F.col("reason") != PASSES).select((F.col("id") + 1).alias("ordinal"), "seq", "reason").orderBy("ordinal")
    first, pairs, count, method, looked = None, None, None, "skipped", 0
    if not skip_distance:
        method = distance_method(good, f.min_distance, low != high)
        passing = judged.filter(F.col("reason") == PASSES).select("id", "seq")
        passing = cut(number(passing.withColumnRenamed("id", "_order"), "_order").select("id", "seq")) if good < n else passing
        span = (low, high, good)
        count = partial(count_pairs, passing, f.min_distance, span)
        pairs = self_join(passing, f.min_distance, span=span)
        row = first_violation(first_pair(passing, f.min_distance, span), good).first()
        if row:
            first, looked = (row["i"] + 1, row["j"] + 1, row["seq1"], row["seq2"], row["distance"]), row["pairs_checked"]
        else:
            looked = good * (good - 1) // 2
    return ValidationResult(good == n and first is None, n, good, n - good, failed, skip_distance, first, method, looked, pairs, count)
