"""An extension: a stream of candidate sequences screened against a fixed pool, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Filter
from ..functions.sequence import passes
from ..operators.similarity import anti_join
from pyspark.sql import functions as F


def screen(stream: DataFrame, pool: DataFrame, f: Filter, sink: str, checkpoint: str) -> StreamingQuery:
    """stream: id, seq. Rows that pass the composition checks and keep the least distance to the pool are appended to sink as Parquet."""

    def batch(rows: DataFrame, number: int) -> None:
        good = rows.filter(passes(F.col("seq"), f))
        anti_join(good, pool, f.min_distance).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
