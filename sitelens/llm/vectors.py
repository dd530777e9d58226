"""Vector rows shared by the vector operators: which rows take part, and groups read as a stream of sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows with an id and finite non-null components, not all zero."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The finite rows of the length that most of them have (ties: the longer)."""
    v = finite(df, id_col, vec_col)
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return v.where(F.size("v") == (dims[0].d if dims else -1))


def matrix(column: pa.Array) -> np.ndarray:
    """A list<double> or binary (doubles) column as rows of a matrix."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(n, -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of batches sorted by their first n_keys integer columns, as (key, slices in order). A group must fit in memory."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            now = tuple(keys[lo].tolist())
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, held
