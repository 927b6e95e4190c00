"""The state of a table's columns in bounded memory: written for each batch, merged, and read as statistics.

A state has one row a column: counts, central moments, a HyperLogLog sketch of the values, a KLL sketch of the numbers and a
frequent-items sketch. States of parts of a table, merged in any order, are a state of the whole; a report follows a growing table by
sketching what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions import exprs as E

DISTINCT_BITS = 14
"""2**14 registers: numbers of distinct values are off by 0.8 % in the mean."""
CUTS = 1600
"""KLL's k: ranks are off by 0.2 % of the rows."""
ITEMS = 1000
"""Frequent items that are tracked: counts are off by 0.2 % of the rows."""
LONG = 256
"""Texts of more characters are known by their SHA-256, so that a state's bytes are bounded."""
RANK_ERROR, COUNT_ERROR, DISTINCT_ERROR = 0.004, 0.002, 0.04
"""What tests hold the three sketches to."""


def _text(df: DataFrame, name: str) -> Column:
    c = E.q(name).cast("string") if not isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.to_json(F.struct(E.q(name)))
    return F.when(F.char_length(c) > LONG, F.sha2(c, 256)).otherwise(c)


def _state(df: DataFrame, name: str) -> Column:
    number = isinstance(df.schema[name].dataType, T.NumericType)
    value = E.number(name) if number else F.lit(None).cast("double")
    text = F.when(E.number(name).isNotNull(), _text(df, name)) if number else _text(df, name)
    n = F.count(value)
    m2 = F.var_pop(value) * n
    return F.struct(
        F.lit(name).alias("column"),
        F.lit(number).alias("numeric"),
        F.count(F.lit(1)).alias("rows"),
        F.count(text).alias("values"),
        n.alias("n"),
        F.avg(value).alias("mean"),
        m2.alias("m2"),
        F.when(m2 > 0, F.skewness(value) * m2 * F.sqrt(m2) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0)).alias("m3"),
        F.when(m2 > 0, (F.kurtosis(value) + 3) * m2 * m2 / n).otherwise(F.lit(0.0)).alias("m4"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.hll_sketch_agg(text, DISTINCT_BITS).alias("distinct"),
        F.kll_sketch_agg_double(value, CUTS).alias("cuts"),
        F.call_function("approx_top_k_accumulate", text, F.lit(ITEMS)).alias("items"),
    )


def sketch(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column, from one scan for every few columns. NaN counts as null; structs, arrays and maps count as their JSON."""
    names = df.columns if columns is None else columns
    made, step = None, max(1, E.WIDE // 14)
    for i in range(0, len(names), step):
        part = df.agg(F.array(*[_state(df, c) for c in names[i : i + step]]).alias("_s")).select(F.inline("_s"))
        made = part if made is None else made.unionByName(part)
    return made


def merged(states: DataFrame) -> DataFrame:
    """States of parts as states of the whole. Moments are moved to the common mean."""
    means = states.groupBy(F.col("column").alias("_c")).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    d = F.col("mean") - F.col("_mean")
    n, m2, m3 = (F.col(c) for c in ("n", "m2", "m3"))
    part = F.when(n > 0, F.lit(True))
    return (
        states.join(means, F.col("column") == F.col("_c"))
        .groupBy("column")
        .agg(
            F.bool_or("numeric").alias("numeric"),
            F.sum("rows").alias("rows"),
            F.sum("values").alias("values"),
            F.sum("n").alias("n"),
            F.first("_mean").alias("mean"),
            F.sum(F.when(part, m2 + n * d * d)).alias("m2"),
            F.sum(F.when(part, m3 + 3 * d * m2 + n * d * d * d)).alias("m3"),
            F.sum(F.when(part, F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d)).alias("m4"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.hll_union_agg("distinct").alias("distinct"),
            F.kll_merge_agg_double("cuts").alias("cuts"),
            F.call_function("approx_top_k_combine", F.col("items"), F.lit(ITEMS)).alias("items"),
        )
    )


def read(states: DataFrame, k: int = 3) -> DataFrame:
    """column, rows, missing, missing_pct, n_unique, mean, std, min, q25, q50, q75, max, skewness, kurtosis and top (the k most frequent
    values with their counts) of a state with one row a column."""
    n = F.col("n").cast("double")
    cut = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("cuts", F.lit(p)))
    spread = F.col("m2") > 0
    g = F.col("m3") * F.sqrt(n) / (F.col("m2") * F.sqrt(F.col("m2")))
    w = F.col("m4") * n / (F.col("m2") * F.col("m2")) - 3
    skewness = F.when(n < 3, F.lit(None)).when(spread, g * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))
    kurtosis = F.when(n < 4, F.lit(None)).when(spread, (n - 1) * ((n + 1) * w + 6) / ((n - 2) * (n - 3))).otherwise(F.lit(0.0))
    missing = F.col("rows") - F.col("values")
    items = F.call_function("approx_top_k_estimate", F.col("items"), F.lit(k + 1))  # null may be one of them
    return states.select(
        "column", "numeric", "rows", missing.alias("missing"), E.percent(missing, F.col("rows")).alias("missing_pct"), F.hll_sketch_estimate("distinct").alias("n_unique"), "mean", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        F.col("lo").alias("min"), cut(0.25).alias("q25"), cut(0.5).alias("q50"), cut(0.75).alias("q75"), F.col("hi").alias("max"), F.when(n > 0, skewness).alias("skewness"), F.when(n > 0, kurtosis).alias("kurtosis"),
        F.slice(F.transform(F.filter(items, lambda t: t["item"].isNotNull()), lambda t: F.struct(t["item"].alias("value"), t["count"].alias("n"))), 1, k).alias("top"),
    )


def distinct_rows(df: DataFrame) -> Column:
    """About how many different rows a table has, as an aggregate of bounded memory."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[E.q(c) for c in E.comparable_columns(df)]), DISTINCT_BITS))
