"""Python kernels over Arrow batches with plain column lists in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

Columns = dict[str, list]


SLICE = 1_000  # rows that are held as Python values at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _array(values: list | np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def map_columns(df: DataFrame, kernel: Callable[[Iterator[Columns]], Iterable[Columns]], ddl: str) -> DataFrame:
    """Run ``kernel`` over the batches of every partition.

    It gets an iterator of {column: values} and yields the same for the columns of ``ddl``, or NumPy and Arrow arrays. Missing
    values are None and integers keep their 64 bits. A batch holds 64 MB or one row and is handed on in slices, so a
    worker's memory does not follow the size of its partition.
    """
    schema = to_arrow_schema(DataType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in _slices(batches))
        for columns in kernel(read):
            arrays = [_array(columns[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)


def map_arrays(df: DataFrame, kernel: Callable[[Iterator[dict[str, np.ndarray]]], Iterable[dict]], ddl: str) -> DataFrame:
    """``map_columns`` for number columns without missing values: the batches are NumPy arrays. The kernel may yield lists."""
    schema = to_arrow_schema(DataType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ({n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns)} for b in batches)
        for columns in kernel(read):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def add_columns(df: DataFrame, read: str, kernel: Callable[[list], Columns], ddl: str, keep: bool = True) -> DataFrame:
    """``df`` with the columns of ``ddl`` that ``kernel`` makes from the values of column ``read``; all others pass untouched.

    Without ``keep`` the column that was read does not come back, so long texts cross to Python only once.
    """
    added = DataType.fromDDL(ddl)
    schema = to_arrow_schema(added)
    names = [c for c in df.columns if keep or c != read]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = kernel(batch.column(read).to_pylist())
            passed = batch.select(names)
            arrays = [*passed.columns, *[pa.array(made[f.name], f.type) for f in schema]]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*passed.schema, *schema]))

    return df.mapInArrow(run, StructType([*df.select(*names).schema.fields, *added.fields]))
