"""Sequence lists as text: one sequence a line, any number of files, read in the order given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut


@dataclass
class SequenceSet:
    """sequences: id, file, line, seq, len (ids from 0 in reading order); rejects: file, line, value."""

    sequences: DataFrame
    rejects: DataFrame

    def length_histogram(self) -> DataFrame:
        return length_histogram(self.sequences)

    def loaded(self) -> DataFrame:
        """(file, n) of the files with any sequence."""
        return self.sequences.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file")

    def has_mixed_lengths(self) -> bool:
        return self.sequences.agg(F.min("len") != F.max("len")).first()[0] or False


def length_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n")).orderBy("len")


def strip(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def is_sequence(value: Column) -> Column:
    """Upper-case bases only."""
    return value.rlike("^[ATGC]+$")


def check_exists(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(conf).exists(where):
            raise ValueError(f"File does not exist: {p}")


def number(df: DataFrame, *order: str) -> DataFrame:
    """df with id: place in the order, from 0. Rows are sorted in ranges and numbered in each by itself."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged.withColumn("_row", F.monotonically_increasing_id() % (1 << 33)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def read_sequences(spark: SparkSession, paths: str | list[str]) -> SequenceSet:
    """All files in the order of the arguments. Blank lines are left out; lines with other characters are rejects.

    Raises ValueError for a missing file, or if no file has any sequence.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    check_exists(spark, paths)
    parts = []
    for k, p in enumerate(paths):
        lines = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "value"))
        parts.append(lines.select(F.lit(k).alias("_file"), F.lit(p).alias("file"), (F.col("line") + 1).cast("long").alias("line"), strip(F.col("value")).alias("value")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = rows.filter("value <> ''")
    good = number(rows.filter(is_sequence(F.col("value"))), "_file", "line").select("id", "file", "line", F.col("value").alias("seq"), F.length("value").alias("len"))
    if good.isEmpty():
        raise ValueError("File(s) are empty: " + ", ".join(paths))
    return SequenceSet(good, rows.filter(~is_sequence(F.col("value"))).select("file", "line", "value"))


def from_dataframe(df: DataFrame, seq: str = "seq", order: str | None = None) -> SequenceSet:
    """Sequences from a column of any source. order: a column that gives their order, else the sequence itself."""
    rows = df.select(F.col(order or seq).alias("_order"), strip(F.col(seq)).alias("value")).filter("value <> ''")
    good = number(rows.filter(is_sequence(F.col("value"))), "_order", "value")
    return SequenceSet(
        good.select("id", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.col("value").alias("seq"), F.length("value").alias("len")),
        rows.filter(~is_sequence(F.col("value"))).select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), "value"),
    )


def check_paired(sides: DataFrame) -> None:
    """sides: side (1 or 2), seq. Equal counts, then one length in each, then one length in both."""
    rows = {r["side"]: r for r in sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high")).collect()}
    one, two = rows.get(1), rows.get(2)
    if (one["n"] if one else 0) != (two["n"] if two else 0):
        raise ValueError(f"Paired seed files must have equal counts, not {one['n'] if one else 0} and {two['n'] if two else 0}")
    for k, r in sorted(rows.items()):
        if r["low"] != r["high"]:
            raise ValueError(f"Paired seed file {k} must have one length, not {r['low']} to {r['high']}")
    if one and one["low"] != two["low"]:
        raise ValueError(f"Paired seed files must have the same length, not {one['low']} and {two['low']}")


def read_paired_seeds(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """(id, side, seq, len): the first file's sequences, then the second's."""
    parts = [read_sequences(spark, p).sequences.withColumn("side", F.lit(k)) for k, p in ((1, path1), (2, path2))]
    both = parts[0].unionByName(parts[1])
    check_paired(both)
    n = parts[0].count()
    return both.withColumn("id", F.col("id") + F.when(F.col("side") == 2, n).otherwise(0)).select("id", "side", "seq", "len")


def write_list(df: DataFrame, path: str, files: int = 1) -> None:
    """One sequence a line in order of id; one file by default, or a sorted range in each."""
    rows = df.orderBy("id").select("seq") if files == 1 else df.repartitionByRange(files, "id").sortWithinPartitions("id").select("seq")
    (rows.coalesce(1) if files == 1 else rows).write.mode("overwrite").text(path)
