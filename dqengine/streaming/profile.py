"""Profiles of streams: windowed statistics with a watermark, and a running profile that batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dqengine.functions import exprs as E


def windowed_profile(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """window_start, column, n, missing, mean, std, min, max of each window; windows close when the watermark has passed."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), E.number(c).alias("value")) for c in columns])
    long = stream.withWatermark(time, lateness).select(E.q(time).alias("_t"), F.explode(cells).alias("_c"))
    v = F.col("_c.value")
    grouped = long.groupBy(F.window("_t", window).alias("_w"), F.col("_c.column").alias("column"))
    stats = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return stats.select(F.col("_w.start").alias("window_start"), "column", "n", "missing", "mean", "std", "min", "max")


def partial_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing, s1, s2, min, max: what can be added up over batches."""
    v = E.number
    return E.tidy(
        df,
        columns,
        {
            "n": lambda c: F.count(v(c)).cast("double"),
            "missing": lambda c: F.count_if(v(c).isNull()).cast("double"),
            "s1": lambda c: F.coalesce(F.sum(v(c)), F.lit(0.0)),
            "s2": lambda c: F.coalesce(F.sum(v(c) * v(c)), F.lit(0.0)),
            "min": lambda c: F.min(v(c)),
            "max": lambda c: F.max(v(c)),
        },
    )


def merged(partials: DataFrame) -> DataFrame:
    """column, n, missing, mean, std, min, max from partial sums of any number of batches."""
    total = partials.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("n", "missing", "s1", "s2")], F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.try_divide(F.col("s1"), F.nullif(F.col("n"), F.lit(0.0)))
    variance = F.try_divide(F.col("s2") - F.col("s1") * mean, F.nullif(F.col("n") - 1, F.lit(0.0)))
    return total.select("column", F.col("n").cast("long").alias("n"), F.col("missing").cast("long").alias("missing"), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"), "min", "max")


def running_profile(stream: DataFrame, columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's partial sums under its number, so a batch that is run again replaces its own; read them with
    ``merged(spark.read.parquet(path))``."""

    def add(batch: DataFrame, number: int) -> None:
        partial_sums(batch, columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
