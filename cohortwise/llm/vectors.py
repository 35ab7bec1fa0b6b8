"""Vector columns of a table as integer rows, read in tasks as NumPy matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from cohortwise.session import materialize


def is_whole(vec: str) -> Column:
    """Whether a vector is there, has an entry, and all its entries are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    values = F.col(vec).cast("array<double>")
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(values, finite), F.lit(False))


def integer_vectors(df: DataFrame, vec: str, scale: int, shift: int, *keep: Column) -> tuple[DataFrame, int]:
    """The columns ``keep`` and ``x``, the entries as ``floor(scale * entry) + shift``, of all whole vectors; written. Also their length.

    Only vectors of one length can be used together: of several lengths the most frequent one stays, of equally frequent
    ones the greatest. The length is 0 if no vector is left.
    """
    whole = df.filter(is_whole(vec))
    entries = F.transform(F.col(vec).cast("array<double>"), lambda c: F.floor(c * scale).cast("bigint") + F.lit(shift))
    rows = materialize(whole.select(*keep, entries.alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.col("n").desc(), F.col("d").desc()).limit(2).collect()
    if not top:
        return rows, 0
    return (rows if len(top) == 1 else rows.filter(F.size("x") == top[0]["d"])), top[0]["d"]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long lists as one row per list."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """``kernel`` turns the Arrow batches of a partition into {column: array or list} for the columns of ``ddl``."""
    schema = to_arrow_schema(DataType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in kernel(b for b in batches if b.num_rows):
            arrays = [v if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)
