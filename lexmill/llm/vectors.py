"""Float vectors as exact integers: floor(256 * x) of every component, kept as little-endian 32-bit integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import flat

SCALE = 256.0
#: Largest component, after scaling, whose squares and products are sure to fit 64-bit sums.
LARGEST = 1 << 24


def scaled(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows hold a vector (of `size` components, if given) without a null or non-finite component, and these as integers.

    Raises OverflowError where a component's floor is beyond LARGEST.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    x = np.where(nulls, np.nan, values.fill_null(0).to_numpy(zero_copy_only=False))
    lengths = np.maximum(sizes, 0)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (sizes >= 0) & (bad[edges[1:]] == bad[edges[:-1]])
    if size is not None:
        ok &= sizes == size
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(SCALE * x)
    kept = whole[np.repeat(ok, lengths)]
    if len(kept) and np.abs(kept).max() > LARGEST:
        raise OverflowError(f"a component's floor(256 * x) is beyond {LARGEST}")
    return ok, np.split(kept.astype("<i4"), np.cumsum(lengths[ok])[:-1]) if ok.any() else []


def integer_vectors(rows: DataFrame, keep: list[str], column: str = "embedding", size: int | None = None) -> DataFrame:
    """The columns `keep` and v, the integers' bytes, of the rows that hold a vector; other columns are left out."""
    schema = rows.select(*keep).schema.add("v", "binary")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, vectors = scaled(batch.column(batch.num_columns - 1), size)
            mask = pa.array(ok)
            kept = [batch.column(i).filter(mask) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "v"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([v.tobytes() for v in vectors], pa.binary())], names=names)

    return rows.select(*keep, F.col(column)).mapInArrow(convert, schema)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column of bytes as rows of `width` integers; shorter ones are filled up with zeros."""
    if not len(column):
        return np.zeros((0, width), dtype=np.int64)
    data, edges = flat(column)
    sizes = np.diff(edges) // 4
    values = data.view("<i4") if len(data) % 4 == 0 and data.flags["C_CONTIGUOUS"] else np.frombuffer(data.tobytes(), "<i4")
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out
