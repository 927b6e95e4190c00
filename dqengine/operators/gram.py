"""Sums of products over all pairs of columns, from matrix products of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 21
"""Cells of a batch that are multiplied at once."""
FAN = 32
"""Parts that the tasks' matrices are added up in before the last sum."""


def _sides(x: np.ndarray) -> dict[str, np.ndarray]:
    """What products are made of: 1 where a value is, the value or 0, and its square."""
    there = ~np.isnan(x)
    value = np.where(there, x, 0.0)
    return {"1": there.astype(np.float64), "x": value, "xx": value * value}


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Rows of the first ``width`` columns as matrices of bounded size, NaN where null."""
    for batch in batches:
        step = max(1, CELLS // max(1, width))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = np.empty((part.num_rows, width))
            for k in range(width):
                x[:, k] = part.column(k).to_numpy(zero_copy_only=False)
            yield x


def column_means(df: DataFrame) -> np.ndarray:
    """Means of a table of doubles, 0 for columns without values: tasks' sums are added up in ``FAN`` parts, which the driver gets."""
    width = len(df.columns)
    schema = T.StructType().add("slot", "integer").add("sums", "binary")

    def row(slot: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([sums.tobytes()], pa.binary())], schema.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros((2, width)), 0
        for batch in batches:
            if batch.num_rows:
                slot = batch.column(width)[0].as_py()
            for x in _matrices(iter([batch]), width):
                total += np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)
        yield row(slot, total)

    def merge(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([row(group["slot"][0].as_py(), sum(np.frombuffer(v.as_py()) for v in group["sums"]))])

    parts = df.withColumn("_slot", F.spark_partition_id()).mapInArrow(add, schema)
    parts = parts.withColumn("slot", F.col("slot") % FAN).groupBy("slot").applyInArrow(merge, schema).collect()
    total = sum((np.frombuffer(p.sums) for p in parts), np.zeros(2 * width)).reshape(2, width)
    return total[0] / np.maximum(total[1], 1)


def gram_sums(df: DataFrame, products: dict[str, tuple[str, str]], schema: str, finish: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """One row for each pair of columns i < j of a table of doubles. ``products`` names sums over rows of a side of i times a side of j
    ("1": a value is there, "x": the value, "xx": its square; all 0 where it is null); ``finish`` turns the sums of one i and many j into
    columns, NaN for null.

    A task adds up one matrix for each product and emits it row by row; rows of equal i are added up in ``FAN`` parts and then as
    a whole, so a merge holds one row of matrices for each ``FAN``-th task.
    """
    width, names = len(df.columns), list(products)
    partial = T.StructType().add("i", "integer").add("slot", "integer")
    for n in names:
        partial.add(n, "binary")

    def emitted(rows: list[int], slots: list[int], sums: dict[str, list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(slots, pa.int32()), *(pa.array(sums[n], pa.binary()) for n in names)], partial.names)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = None, 0
        for batch in batches:
            if batch.num_rows:
                slot = batch.column(width)[0].as_py()
            for x in _matrices(iter([batch]), width):
                sides = _sides(x)
                found = {n: sides[a].T @ sides[b] for n, (a, b) in products.items()}
                total = found if total is None else {n: total[n] + found[n] for n in names}
        if total is not None:
            for i in range(width - 1):
                yield emitted([i], [slot], {n: [total[n][i, i + 1 :].tobytes()] for n in names})

    def add(group: pa.Table) -> pa.Table:
        sums = {n: [sum(np.frombuffer(v.as_py()) for v in group[n]).tobytes()] for n in names}
        return pa.Table.from_batches([emitted([group["i"][0].as_py()], [group["slot"][0].as_py()], sums)])

    rows = df.withColumn("_slot", F.spark_partition_id()).mapInArrow(multiply, partial)
    for slot in (F.col("slot") % FAN, F.lit(0)):
        rows = rows.withColumn("slot", slot).groupBy("i", "slot").applyInArrow(add, partial)

    names_out = [x.split()[0] for x in schema.split(", ")]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, i in enumerate(batch.column("i").to_pylist()):
                j = np.arange(i + 1, width)
                out = finish(np.full(len(j), i), j, {n: np.frombuffer(batch.column(n)[r].as_py()) for n in names})
                columns = {"i": np.full(len(j), i, np.int32), "j": j.astype(np.int32), **out}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], from_pandas=True) for n in names_out], names_out)

    return rows.mapInArrow(pairs, schema)
