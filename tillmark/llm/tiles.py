"""Vectors packed into blocks, and the pairs of blocks whose products make up a large matrix product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.sources.shared import written


def finite(vector: Column) -> Column:
    """Neither null nor empty, and no component null, NaN or infinite."""
    value = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, value), F.lit(False))


def blocks(rows: DataFrame, keys: Sequence[str], vector: str, size: int, name: str) -> DataFrame:
    """dim, block (0, 1, ... for each dim), n, one binary of 64-bit integers per key, and the vectors' bytes as ``data``.

    ``rows`` should be a written table: it is counted to choose the number of blocks. A block holds vectors of one length.
    """
    kind = np.dtype({"float": "<f4", "double": "<f8", "bigint": "<i8"}[rows.schema[vector].dataType.elementType.simpleString()])
    names = ["dim", "n", *keys, "data"]

    def pack(held: list) -> pa.RecordBatch:
        ids = [np.concatenate([h[i] for h in held]) for i in range(len(keys))]
        data = np.concatenate([h[-1] for h in held])
        values = [data.shape[1], len(data), *(x.astype("<i8").tobytes() for x in ids), np.ascontiguousarray(data).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 2 else pa.binary()) for i, v in enumerate(values)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column(len(keys))
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(kind)
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            lengths = np.diff(offsets)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                data = flat[offsets[at][:, None] + np.arange(dim)]
                own = held.setdefault(dim, [])
                for start in range(0, len(at), size):
                    part = slice(start, start + size)
                    own.append([*(x[at[part]] for x in ids), data[part]])
                    if sum(len(h[-1]) for h in own) >= size:
                        yield pack(own)
                        own.clear()
        for own in held.values():
            if own:
                yield pack(own)

    count = max(1, -(-rows.count() // size))
    fields = "dim int, n int, " + ", ".join(f"`{k}` binary" for k in keys) + ", data binary"
    packed = rows.select(*keys, vector).repartition(count).mapInArrow(run, fields)
    packed = written(packed.withColumn("_uid", F.monotonically_increasing_id()), name)
    number = F.row_number().over(Window.partitionBy("dim").orderBy("_uid")) - 1
    numbers = packed.select("_uid", "dim").withColumn("block", number).select("_uid", "block")
    return packed.join(numbers, "_uid").drop("_uid")


def block_counts(packed: DataFrame) -> DataFrame:
    return packed.groupBy("dim").agg(F.count("*").cast("int").alias("blocks"))


def exact_product(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """a @ b.T of integer matrices, exact: in floats while every partial sum, at most ``bound``, is a whole number there."""
    if bound < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def norm_bound(a: np.ndarray, b: np.ndarray) -> float:
    """No partial sum of a product of rows of a and b is larger in size."""
    if not len(a) or not len(b):
        return 0.0
    longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))
    return 1.0001 * longest(a) * longest(b) + 1
