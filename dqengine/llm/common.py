"""What the operators of this subpackage share: reading, cutting lineage, Arrow slices and digests."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but ASCII white space."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer scan partitions than the cluster has cores (a single small file) is dealt out evenly."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new local one in a local session
    and an error on a cluster, whose executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_dqengine_shared", None) or "file://" + tempfile.mkdtemp(prefix="dqengine-")
        spark._dqengine_shared = found
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder (or to ``path``) and reads it back, so later steps survive lost executors and
    don't repeat what came before. The shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


HOT_KEYS = 10_000
"""Most keys of a join that are taken for hot and broadcast; each has more than that part of all rows."""
FEW_KEYS = 200_000
"""Rows of a few numbers each up to which a side of a join is broadcast whole."""


def join_hot(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], weight: str) -> DataFrame:
    """left joined with right, whose keys are unique and whose ``weight`` says how many rows of left a key has. A right side of
    at most ``FEW_KEYS`` rows is broadcast. Of a larger one, keys with more than a ``HOT_KEYS``-th of all rows, which can't be
    more than ``HOT_KEYS``, are broadcast, so no task gathers such a key's rows."""
    equal = lambda names: reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(left_keys, names)])
    n, rows = right.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= FEW_KEYS:
        return left.join(F.broadcast(right), equal(right_keys)).drop(*right_keys)
    most = max(100, rows // HOT_KEYS + 1)
    hot, cold = right.where(F.col(weight) > most), right.where(F.col(weight) <= most)
    own = [f"_hot_key{i}" for i in range(len(left_keys))]
    hot_keys = F.broadcast(hot.select(*[F.col(c).alias(k) for c, k in zip(right_keys, own)]))
    rest = left.join(hot_keys, equal(own), "left_anti").join(cold, equal(right_keys))
    return left.join(F.broadcast(hot), equal(right_keys)).unionByName(rest).drop(*right_keys)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def struct_of(fields: str) -> T.StructType:
    """A schema of plain types from "name type, ..." without a session, so that modules may hold one."""
    made = T.StructType()
    for name, kind in (x.split() for x in fields.split(",")):
        made.add(name, {"int": "integer"}.get(kind, kind))
    return made


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
"""bytes.translate table for the same."""


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by rows so that each slice holds about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(offsets(batch.column(column)))
        place = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    free_memory()


def free_memory() -> None:
    """Gives memory that a worker no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freed(rows: pa.Table) -> pa.Table:
    """A group's result, after memory has been freed."""
    free_memory()
    return rows


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array's values in its data buffer."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if array.buffers()[1] is None:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * kind.itemsize).astype(np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each starts; nulls are empty."""
    at = offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    if array.null_count:
        lengths = np.diff(at)
        null = array.is_null().to_numpy(zero_copy_only=False)
        if lengths[null].any():
            raw = raw[np.repeat(~null, lengths)]
            at = np.r_[0, np.cumsum(np.where(null, 0, lengths))]
            return raw, at
    return raw, at - at[0]


def plain_strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]
