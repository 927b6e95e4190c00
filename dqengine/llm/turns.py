"""Turns of conversations in order, dealt out by ranges of the order, so that a conversation of any length takes many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import partitions

TURN_DIGEST_SQL = "sha256(length(role) || ':' || role || ':' || text)"
"""DuckDB's form of ``turn_digest``."""


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text, neither null; turns of one number stand in its order."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conv_id, turn (nulls first) and _digest; _at is a number that grows in this order, _range the range of the order that
    a row is in. Rows stand in this order inside of ranges until the next shuffle."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_digest")]
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
