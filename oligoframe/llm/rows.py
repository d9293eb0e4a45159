"""Row-wise operators over Arrow batches that keep the other columns of the input."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import small_batches


def extend(docs: DataFrame, added: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the columns ``added``, which ``make()(batch)`` returns in order; a column of the same name, in whatever case, is replaced.

    No shuffle. ``drop``: columns that the result doesn't carry.
    """
    small_batches(docs.sparkSession)
    new = added.fieldNames()
    gone = {n.lower() for n in (*drop, *new)}
    at = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in gone]
    keep = [docs.schema.fields[i] for i in at]
    kept = [f.name for f in keep]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        row = make()
        for b in batches:
            out = row(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in at] + [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, t) for x, t in zip(out, arrow, strict=True)],
                names=kept + new,
            )

    return docs.mapInArrow(run, T.StructType(keep + added.fields))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
