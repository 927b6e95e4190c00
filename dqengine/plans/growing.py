"""The report of a table that grows: each batch leaves a state in a folder, the report is read from the states alone.

A batch's state is its columns' sketches, the moments of every pair of numeric columns and a sketch of its rows. It lies under the
batch's number, so a batch that is run again replaces its own. States hold a bounded number of bytes a column or pair, whatever
the number of rows, and merge in any order. What needs the rows themselves (consistency of texts, anything about a target) is not
part of it; ``NOT_COVERED`` names it in the report and the score takes it for faultless.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dqengine.functions import exprs as E
from dqengine.operators import gram, sketches
from dqengine.plans import issues, scoring

PAIR = "column_a string, column_b string, n double, mean_a double, mean_b double, m2_a double, m2_b double, m11 double"
MOMENTS = [field.split()[0] for field in PAIR.split(", ")[2:]]
NOT_COVERED = ("consistency", "target")
FENCE = 1.5
HIGH = 0.8


def pair_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """For every pair of numeric columns, over rows that have both: their number, both means, both sums of squares and the sum of
    products about the means. NaN and infinities count as null; fewer than two columns give no rows."""
    names = E.numeric_columns(df) if columns is None else columns
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR)
    numbers = df.select(*[E.finite(c).alias(f"_{i}") for i, c in enumerate(names)])
    centre = gram.column_means(numbers)
    centred = numbers.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(numbers.columns, centre)])

    def finish(i, j, s) -> dict:
        n = np.maximum(s["n"], 1)
        a, b = s["x"] / n, s["y"] / n
        return {"n": s["n"], "mean_a": a + centre[i], "mean_b": b + centre[j], "m2_a": s["xx"] - s["x"] * a, "m2_b": s["yy"] - s["y"] * b, "m11": s["xy"] - s["x"] * b}

    products = {"n": ("1", "1"), "x": ("x", "1"), "y": ("1", "x"), "xx": ("xx", "1"), "yy": ("1", "xx"), "xy": ("x", "x")}
    sums = gram.gram_sums(centred, products, "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS), finish)
    named = F.array(*[F.lit(c) for c in names])
    return sums.select(named[F.col("i")].alias("column_a"), named[F.col("j")].alias("column_b"), *MOMENTS)


def merged_pairs(states: DataFrame) -> DataFrame:
    """Moments of parts as moments of the whole, moved to the common means; the names of a pair are put in order first, for batches
    may have their columns in different orders."""
    turned = F.col("column_a") > F.col("column_b")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    other = {"column_a": "column_b", "mean_a": "mean_b", "m2_a": "m2_b"}
    other |= {b: a for a, b in other.items()}
    states = states.where("n > 0").select(*[pick(c, other.get(c, c)).alias(c) for c in states.columns])
    pair = ["column_a", "column_b"]
    mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n"))
    means = states.groupBy(*pair).agg(mean("mean_a").alias("_a"), mean("mean_b").alias("_b"))
    da, db, n = F.col("mean_a") - F.col("_a"), F.col("mean_b") - F.col("_b"), F.col("n")
    return (
        states.join(means, pair)
        .groupBy(*pair)
        .agg(
            F.sum("n").alias("n"),
            F.first("_a").alias("mean_a"),
            F.first("_b").alias("mean_b"),
            F.sum(F.col("m2_a") + n * da * da).alias("m2_a"),
            F.sum(F.col("m2_b") + n * db * db).alias("m2_b"),
            F.sum(F.col("m11") + n * da * db).alias("m11"),
        )
    )


def pair_correlations(states: DataFrame) -> DataFrame:
    """column_a, column_b, r of merged moments; null where a column is constant or the rows are fewer than two."""
    flat = lambda c, mean: F.col(c) <= 1e-13 * (F.col(c) + F.col("n") * F.col(mean) * F.col(mean))
    r = F.col("m11") / F.sqrt(F.col("m2_a") * F.col("m2_b"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    return states.select("column_a", "column_b", F.when((F.col("n") >= 2) & ~flat("m2_a", "mean_a") & ~flat("m2_b", "mean_b"), bounded).alias("r"))


def row_state(df: DataFrame) -> DataFrame:
    """One row: the number of rows, and a sketch of different ones."""
    names = E.comparable_columns(df)
    sign = F.xxhash64(*[E.q(c) for c in names]) if names else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(sign, sketches.DISTINCT_BITS).alias("distinct"))


STATES = {"columns": sketches.sketch, "pairs": pair_moments, "rows": row_state}


def add(df: DataFrame, folder: str, batch: int) -> None:
    """Writes the state of a batch. A number that is there is replaced."""
    df = df.persist()
    try:
        for name, state in STATES.items():
            state(df).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/batch={batch}")
    finally:
        df.unpersist()


def follow(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Adds what a stream has to offer, batch by batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: add(batch, folder, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _beyond(states: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, int]:
    """How many values of each column lie outside its fences, by the ranks of its sketch; only fences pass the driver."""
    if not fences:
        return {}
    # Ranks count ties in, so the lower one is asked for just below.
    asked = [at for lower, upper in fences.values() for at in (math.nextafter(lower, -math.inf), upper)]
    ranks = states.where(F.col("column").isin(list(fences))).select("column", "n", F.kll_sketch_get_rank_double("cuts", F.array(*map(F.lit, asked))).alias("_r"))
    place = F.array_position(F.array(*map(F.lit, fences)), F.col("column")).cast("int")
    outside = F.col("n") * (F.element_at("_r", 2 * place - 1) + 1 - F.element_at("_r", 2 * place))
    return {r["column"]: int(r.outside) for r in ranks.select("column", F.round(outside).alias("outside")).collect()}


def evidence(spark: SparkSession, folder: str) -> scoring.Evidence:
    """The evidence of all batches. Missing values, moments and correlations are exact; quartiles, fences, frequent and distinct
    values and duplicates have the errors of ``operators.sketches``. Columns that are not numeric count as categories."""
    folder = folder.rstrip("/")
    load = lambda name: spark.read.parquet(f"{folder}/{name}").drop("batch")
    whole = sketches.merged(load("columns"))
    columns = sketches.read(whole, 1).join(whole.select("column", "n"), "column").orderBy("column").collect()
    fences = {r["column"]: (r.q25 - FENCE * (r.q75 - r.q25), r.q75 + FENCE * (r.q75 - r.q25)) for r in columns if r.q25 is not None}
    outside = _beyond(whole, fences)
    rows, distinct = load("rows").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.hll_sketch_estimate(F.hll_union_agg("distinct"))).first()
    correlations = pair_correlations(merged_pairs(load("pairs"))).where("r is not null").collect()

    e = scoring.Evidence(rows=rows, columns=len(columns))
    more = rows - distinct if rows - distinct > sketches.DISTINCT_ERROR * rows else 0
    e.duplicate_pct = round(100 * more / max(1, rows), 2)
    e.missing_by_column = {r["column"]: r.missing_pct for r in columns if r.missing}
    e.missing_pct = round(sum(e.missing_by_column.values()) / max(1, len(columns)) + 1e-9, 2)
    numbers, texts = [r for r in columns if r.numeric], [r for r in columns if not r.numeric]
    e.numerical, e.categorical = len(numbers), len(texts)
    counts = {r["column"]: r.n for r in numbers}
    e.outlier_pct = {c: round(100 * k / counts[c], 2) for c, k in outside.items()}
    high = sorted((r for r in correlations if abs(r.r) > HIGH), key=lambda r: (-abs(r.r), r.column_a, r.column_b))
    e.high_pairs, e.max_abs_r = len(high), max((abs(r.r) for r in correlations), default=0.0)
    variance = {r["column"]: r.std**2 for r in numbers if r.std is not None}
    e.low_variance = sum(v < 0.01 for v in variance.values())
    e.high_cardinality = sum(r.n_unique > 50 for r in texts)
    e.binary = sum(r.n_unique == 2 for r in columns)
    e.details = {
        "duplicate_rows": more,
        "outliers": {c: {"outliers": k, "outlier_pct": e.outlier_pct[c], "lower": fences[c][0], "upper": fences[c][1]} for c, k in outside.items()},
        "high_correlations": [r.asDict() for r in high],
        "numeric_features": {r["column"]: {"variance": variance.get(r["column"]), "low_variance": variance.get(r["column"], 1.0) < 0.01, "n_unique": r.n_unique} for r in numbers},
        "categorical_features": {r["column"]: {"n_unique": r.n_unique, "cardinality": "high" if r.n_unique > 50 else "medium" if r.n_unique > 10 else "low", "mode": r.top[0]["value"], "mode_count": r.top[0]["n"]} for r in texts if r.top},
    }
    return e


def report(spark: SparkSession, folder: str) -> dict:
    """Score, profile, issues and steps of all batches so far."""
    e = evidence(spark, folder)
    return {
        "rows": e.rows,
        "columns": e.columns,
        "quality_score": scoring.quality(e),
        "data_profile": {"missing_pct": e.missing_pct, "missing": e.missing_by_column, "duplicate_pct": e.duplicate_pct, **e.details},
        "detected_issues": issues.detected(e),
        "preprocessing_recommendations": issues.preprocessing(e),
        "not_covered": list(NOT_COVERED),
    }
