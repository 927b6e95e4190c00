"""Values ready for showing: a metric table, bands and short numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.operators import profile


def metric_table(df: DataFrame, size_mb: float = 0.0) -> DataFrame:
    """metric, value: rows, columns, complete and duplicate rows, missing share and size in GB."""
    d, m = profile.duplicates(df), profile.missing_summary(df)
    cells = {
        "total_rows": F.col("rows"), "total_columns": F.lit(len(df.columns)), "complete_rows": F.col("complete_rows"), "unique_rows": F.col("unique_rows"),
        "duplicate_rows": F.col("duplicate_rows"), "missing_pct": F.col("missing_pct"), "size_gb": F.lit(size_mb / 1024),
    }
    row = d.join(F.broadcast(m))  # one row each
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in cells.items()])))


def confidence_band(percent: float) -> str:
    return "high" if percent >= 80 else "medium" if percent >= 60 else "low"


def short_number(n: float) -> str:
    """1,234,567 as 1.2M, 1,234 as 1.2K."""
    return f"{n / 1e6:.1f}M" if n >= 1e6 else f"{n / 1e3:.1f}K" if n >= 1e3 else f"{n:g}"


def profile_summary(df: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """mean_outlier_pct, columns_with_outliers (over 5%), and of importances (feature, mi) the largest and the mean."""
    o = profile.outliers(df).agg(F.round(F.avg("outlier_pct"), 2).alias("mean_outlier_pct"), F.count_if(F.col("outlier_pct") > 5).alias("columns_with_outliers"))
    if importance is None:
        return o
    return o.join(F.broadcast(importance.agg(F.round(F.max("mi"), 4).alias("max_importance"), F.round(F.avg("mi"), 4).alias("mean_importance"))))
