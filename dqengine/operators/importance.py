"""Mutual information of features and a target, in nats, from one table of counts.

Numeric features with more than ``bins`` values are cut at quantiles; a binned estimate stands in for a nearest-neighbour one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions import exprs as E


def binned(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Numeric columns with more than ``bins`` values replaced by the number of quantile borders below them."""
    numbers = [c for c in columns if c in E.numeric_columns(df)]
    if not numbers:
        return df
    wide = df.agg(*[F.approx_count_distinct(E.q(c)).alias(f"_{i}") for i, c in enumerate(numbers)]).first()
    cut = [c for i, c in enumerate(numbers) if wide[i] > bins]
    if not cut:
        return df
    at = [i / bins for i in range(1, bins)]
    edges = df.agg(*[F.percentile_approx(E.finite(c), at, 10_000).alias(f"_{i}") for i, c in enumerate(cut)]).first()
    for i, c in enumerate(cut):
        borders = sorted(set(edges[i] or []))
        slot = sum(((E.q(c) > b).cast("int") for b in borders), F.lit(0))
        df = df.withColumn(c, F.when(E.q(c).isNotNull(), slot))
    return df


def _n_ln_n(c: str) -> Column:
    return F.col(c) * F.ln(F.col(c).cast("double"))


def mutual_information(df: DataFrame, target: str, features: list[str] | None = None, bins: int = 20) -> DataFrame:
    """feature, mi. Nulls are a value of their own."""
    names = [c for c in (features or E.comparable_columns(df)) if c != target]
    ready = binned(df.select(*[E.q(c) for c in [*names, target]]), [*names, target], bins)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), E.q(c).cast("string").alias("x")) for c in names])
    joint = ready.select(F.explode(cells).alias("_c"), E.q(target).cast("string").alias("y")).groupBy("_c.feature", "_c.x", "y").agg(F.count(F.lit(1)).alias("n"))
    # H(x) + H(y) - H(x, y), each from one sum of n ln n, so that counts are only ever aggregated.
    whole = joint.groupBy("feature").agg(F.sum(_n_ln_n("n")).alias("_xy"), F.sum("n").cast("double").alias("_n"))
    for side in ("x", "y"):
        counts = joint.groupBy("feature", side).agg(F.sum("n").alias("n")).groupBy(F.col("feature").alias(f"_{side}_of"))
        whole = whole.join(counts.agg(F.sum(_n_ln_n("n")).alias(f"_{side}")), F.col("feature") == F.col(f"_{side}_of"))
    mi = F.ln("_n") + (F.col("_xy") - F.col("_x") - F.col("_y")) / F.col("_n")
    return whole.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))

