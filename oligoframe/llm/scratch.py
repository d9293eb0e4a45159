"""Session helpers of the operators: written tables, the package on the executors, batch sizes, tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..lineage import cut, release, shared_dir

__all__ = ["cut", "fresh", "release", "shared_dir", "ship", "small_batches", "table"]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed; once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_oligoframe_sent", False):
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="oligoframe-")) / "oligoframe.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        sc._oligoframe_sent = True


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of 2 MB, or one row, so that a worker's memory is bounded by them; narrow rows in batches as usual."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().removesuffix("b")) > 2 << 20:
        spark.conf.set(key, str(2 << 20))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of df has, in whatever case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
