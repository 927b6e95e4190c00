"""Statistics of a table as tidy DataFrames: each a fixed number of jobs however many columns there are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.functions import catalogs as C
from dqengine.functions import exprs as E
from dqengine.operators.gram import column_means, gram_sums
from dqengine.operators.quantiles import order_statistics


def column_classes(df: DataFrame) -> dict[str, str]:
    """numerical, categorical, datetime or boolean for each column; a string column whose values all parse as dates (and that
    has any) is datetime. Nulls don't count."""
    found, texts = {}, E.string_columns(df)
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            found[f.name] = "numerical"
        elif isinstance(f.dataType, T.BooleanType):
            found[f.name] = "boolean"
        else:
            found[f.name] = "datetime" if f.name in E.temporal_columns(df) else "categorical"
    if texts:
        # A column whose least or greatest value is no date is decided by one pass without parsing; of others each distinct value is parsed.
        ends = lambda c: F.coalesce(E.parse_date(F.min(E.q(c))).isNotNull() & E.parse_date(F.max(E.q(c))).isNotNull(), F.lit(False))
        open_ = [r["column"] for r in E.tidy(df, texts, {"ends": ends}, "boolean").where("ends").collect()]
        if open_:
            # Counts are summed: Spark moves a filter on values below the grouping, and drops a grouping under a minimum; both parse rows.
            odd = F.sum(F.when(F.col("value").isNotNull() & E.parse_date(F.col("value")).isNull(), F.col("n")).otherwise(0))
            found |= {r["column"]: "datetime" for r in value_counts(df, open_).groupBy("column").agg(odd.alias("odd")).where("odd = 0").collect()}
    return found


def basic_info(df: DataFrame) -> DataFrame:
    """rows, columns and an estimate of the bytes that the values hold in memory."""
    def width(f: T.StructField) -> Column:
        c = E.q(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(F.sum(F.length(c) + 8), F.lit(0)).cast("long")
        return F.count(F.lit(1)) * (1 if isinstance(f.dataType, T.BooleanType) else 8)

    total = sum((width(f) for f in df.schema), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), total.alias("value_bytes"))


def is_missing(df: DataFrame, name: str) -> Column:
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return E.q(name).isNull() | F.isnan(E.q(name)) if floating else E.q(name).isNull()


def missing(df: DataFrame) -> DataFrame:
    """column, missing, missing_pct."""
    n = F.count(F.lit(1))
    return E.tidy(df, df.columns, {"missing": lambda c: F.count_if(is_missing(df, c)), "missing_pct": lambda c: E.percent(F.count_if(is_missing(df, c)), n)})


def missing_summary(df: DataFrame) -> DataFrame:
    """Cells missing, their share, and rows without any."""
    per_row = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    n = F.count(F.lit(1))
    return df.agg(F.sum(per_row).alias("total_missing"), E.percent(F.sum(per_row), n * len(df.columns)).alias("missing_pct"), F.count_if(per_row == 0).alias("complete_rows"))


def row_missing_histogram(df: DataFrame) -> DataFrame:
    per_row = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    return df.groupBy(per_row.cast("int").alias("missing_columns")).agg(F.count(F.lit(1)).alias("rows"))


def co_missing(df: DataFrame, least_pct: float = 0.0) -> DataFrame:
    """column_a, column_b, rows in which both are missing, for pairs that have any."""
    flags = df.select(*[is_missing(df, c).cast("double").alias(f"_{i}") for i, c in enumerate(df.columns)])
    n = df.count() if least_pct else 0
    sums = gram_sums(flags, {"both": ("x", "x")}, "i int, j int, both_missing long", lambda i, j, s: {"both_missing": s["both"].round().astype("int64")})
    sums = sums.where((F.col("both_missing") > 0) & (F.col("both_missing") * 100.0 > F.lit(n * least_pct)))
    return _named_pairs(sums, df.columns, "both_missing")


def _named_pairs(pairs: DataFrame, names: list[str], *values: str) -> DataFrame:
    name = F.array(*map(F.lit, names))
    return pairs.select(F.element_at(name, F.col("i") + 1).alias("column_a"), F.element_at(name, F.col("j") + 1).alias("column_b"), *values)


def duplicates(df: DataFrame) -> DataFrame:
    """rows, duplicate_rows (beyond the first of each), duplicate_pct, unique_rows; nulls are equal to nulls."""
    grouped = df.groupBy(*[E.q(c) for c in E.comparable_columns(df)]).agg(F.count(F.lit(1)).alias("_n"))
    n, d = F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))
    return grouped.agg(n.alias("rows"), (n - d).alias("duplicate_rows"), E.percent(n - d, n).alias("duplicate_pct"), d.alias("unique_rows"))


def duplicate_flags(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with ``is_duplicate``: an earlier row in ``order``, which must tell rows of equal keys apart, has the same keys. The
    first row of each key is an aggregate that combines within tasks, and a join that can be split where a key is hot."""
    place = lambda names: F.struct(*[E.q(c) for c in names])
    firsts = df.groupBy(place(keys).alias("_key")).agg(F.min(place(order)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = df.join(firsts, place(keys).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("is_duplicate", F.coalesce(place(order) != F.col("_first"), F.lit(False))).drop("_key", "_first", "_n")


def quartiles(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, list[float]]:
    """The three quartiles of each numeric column that has values: by distributed selection, or from sketches."""
    if exact:
        return order_statistics(df, columns)
    found = E.tidy(df, columns, {f"q{i}": lambda c, i=i: E.sketched_quartile(E.number(c), i) for i in (1, 2, 3)}).where("q1 is not null").collect()
    return {r["column"]: [r.q1, r.q2, r.q3] for r in found}


def numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles, max, skewness and kurtosis of each numeric column. ``exact=False`` takes sketches for
    the quartiles, which are one pass more instead of a few."""
    names = E.numeric_columns(df) if columns is None else columns
    cuts = quartiles(df, names, exact)
    cut = lambda c, i: F.lit(cuts[c][i] if c in cuts else None).cast("double")
    metrics = {
        "n": lambda c: F.count(E.number(c)).cast("double"),
        "mean": lambda c: F.avg(E.number(c)),
        "std": lambda c: F.stddev_samp(E.number(c)),
        "min": lambda c: F.min(E.number(c)),
        "q25": lambda c: cut(c, 0),
        "q50": lambda c: cut(c, 1),
        "q75": lambda c: cut(c, 2),
        "max": lambda c: F.max(E.number(c)),
        "skewness": lambda c: E.adjusted_skewness(E.number(c)),
        "kurtosis": lambda c: E.adjusted_kurtosis(E.number(c)),
    }
    return E.tidy(df, names, metrics).where("n > 0")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_a, column_b, r for every pair of numeric columns, over rows that have both; null where either is constant there.
    Sums of products come from the matrices of Arrow batches, taken from the columns' means, so that any number of pairs is one
    pass."""
    names = E.numeric_columns(df) if columns is None else columns
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    numbers = df.select(*[E.finite(c).alias(f"_{i}") for i, c in enumerate(names)])
    centred = numbers.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(numbers.columns, column_means(numbers))])
    sums = gram_sums(centred, {"n": ("1", "1"), "x": ("x", "1"), "y": ("1", "x"), "xx": ("xx", "1"), "yy": ("1", "xx"), "xy": ("x", "x")}, "i int, j int, r double", _pearson)
    return _named_pairs(sums, names, "r")


def _pearson(i, j, s) -> dict:
    """r from sums over rows that have both; None where a variance is nothing but rounding."""
    n = np.maximum(s["n"], 1)
    vx, vy = s["xx"] - s["x"] ** 2 / n, s["yy"] - s["y"] ** 2 / n
    flat = (vx <= 1e-13 * s["xx"]) | (vy <= 1e-13 * s["yy"]) | (s["n"] < 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (s["xy"] - s["x"] * s["y"] / n) / np.sqrt(vx * vy)
    return {"r": np.where(flat, np.nan, np.clip(r, -1, 1))}


def high_correlations(df: DataFrame, threshold: float = 0.8, columns: list[str] | None = None) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > threshold)


def outlier_bounds(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> list[tuple[str, float, float]]:
    """(column, lower, upper) fences at 1.5 interquartile ranges: one row per column on the driver."""
    found = quartiles(df, E.numeric_columns(df) if columns is None else columns, exact)
    return [(c, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in found.items()]


def outliers(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column, outliers, outlier_pct (of non-null values), lower, upper."""
    bounds = {c: (a, b) for c, a, b in outlier_bounds(df, columns, exact)}
    beyond = lambda c: F.count_if((E.number(c) < bounds[c][0]) | (E.number(c) > bounds[c][1]))
    metrics = {"outliers": lambda c: beyond(c).cast("double"), "outlier_pct": lambda c: E.percent(beyond(c), F.count(E.number(c))), "lower": lambda c: F.lit(bounds[c][0]), "upper": lambda c: F.lit(bounds[c][1])}
    return E.tidy(df, list(bounds), metrics)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value (as string), n: the distinct values of all columns in one shuffle."""
    names = E.string_columns(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), E.q(c).cast("string").alias("value")) for c in names])
    return df.select(F.explode(cells).alias("_c")).select("_c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_unique, cardinality, mode (the least of the most frequent) and its count."""
    counts = value_counts(df, columns).where("value is not null")
    first = F.min(F.struct((-F.col("n")).alias("k"), "value"))
    n = F.count(F.lit(1))
    band = F.when(n > 50, "high").when(n > 10, "medium").otherwise("low")
    return counts.groupBy("column").agg(n.alias("n_unique"), band.alias("cardinality"), first["value"].alias("mode"), (-first["k"]).alias("mode_count"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 3) -> DataFrame:
    """column, value, n, rank: the k most frequent values; ties by value. Ranks are cut at k before the shuffle as well, so no
    task gets more than k values from each other task."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return value_counts(df, columns).where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dominant_values(df: DataFrame, columns: list[str] | None = None, share: float = 0.5) -> DataFrame:
    """column, value, n, share of values that cover more than ``share`` of the column's rows and are neither blank nor 'nan'."""
    counts = value_counts(df, columns).where("value is not null")
    total = counts.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("_all"))
    part = counts.join(total, F.col("column") == F.col("_c")).withColumn("share", F.col("n") / F.col("_all"))
    return part.where((F.col("share") > share) & ~E.normal(F.col("value")).isin("", "nan")).select("column", "value", "n", "share")


def numeric_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, variance, low_variance (< 0.01), n_unique, is_constant."""
    names = E.numeric_columns(df) if columns is None else columns
    moments = E.tidy(df, names, {"variance": lambda c: F.var_samp(E.number(c))})
    if not names:
        return moments.selectExpr("column", "variance", "false as low_variance", "0L as n_unique", "true as is_constant")
    # Distinct numbers are told apart as numbers: a column's place and a double a cell.
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), E.number(c).alias("_x")) for i, c in enumerate(names)]))).where("_x is not null")
    distinct = cells.groupBy("_i", "_x").agg(F.lit(1)).groupBy("_i").agg(F.count(F.lit(1)).alias("n_unique")).select(F.element_at(F.array(*map(F.lit, names)), F.col("_i") + 1).alias("_c"), "n_unique")
    joined = moments.join(distinct, F.col("column") == F.col("_c"), "left")
    n = F.coalesce("n_unique", F.lit(0))
    return joined.select("column", "variance", F.coalesce(F.col("variance") < 0.01, F.lit(False)).alias("low_variance"), n.alias("n_unique"), (n <= 1).alias("is_constant"))


def unique_ratio(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column, n_unique, ratio to all rows, almost_unique (> 0.95)."""
    names = df.columns if columns is None else columns
    if exact:
        counts = value_counts(df, names).groupBy("column").agg(F.count("value").alias("n_unique"), F.sum("n").alias("_rows"))
    else:
        counts = E.tidy(df, names, {"n_unique": lambda c: F.approx_count_distinct(E.q(c)), "_rows": lambda c: F.count(F.lit(1))})
    ratio = F.try_divide(F.col("n_unique").cast("double"), F.col("_rows"))
    return counts.select("column", "n_unique", ratio.alias("ratio"), (ratio > 0.95).alias("almost_unique"))


def binary_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, is_binary: all values among {0, 1}, {yes, no} or {true, false}; columns without values count."""
    names = df.columns if columns is None else columns
    texts = set(E.string_columns(df))

    def outside(c: str, allowed: tuple[str, ...]) -> Column:
        value = F.lower(E.q(c)) if c in texts else E.q(c).cast("double").cast("string") if c in E.numeric_columns(df) else E.q(c).cast("string")
        return F.count_if(E.q(c).isNotNull() & ~value.isin(*allowed))

    def binary(c: str) -> Column:
        sets = [("yes", "no")] if c in texts else [("0.0", "1.0")] if c in E.numeric_columns(df) else [("true", "false")]
        return F.least(*[outside(c, s) for s in sets], F.lit(1 << 62).cast("long")) == 0

    return E.tidy(df, names, {"is_binary": binary}, "boolean")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """classes, rows, balanced (largest share < 0.6), imbalance_ratio, majority and minority label (ties by label)."""
    counts = df.where(E.q(target).isNotNull()).groupBy(E.q(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top, low = F.min(F.struct((-F.col("n")).alias("k"), "label")), F.min(F.struct("n", "label"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("rows"),
        (F.max("n") < 0.6 * F.sum("n")).alias("balanced"),
        F.try_divide(F.max("n").cast("double"), F.min("n")).alias("imbalance_ratio"),
        top["label"].alias("majority"),
        low["label"].alias("minority"),
    )


def target_statistics(df: DataFrame, target: str) -> DataFrame:
    """Moments of a numeric target."""
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ValueError(f"target {target} is not numeric")
    return numeric_summary(df, [target]).select("column", "mean", "std", "min", "max", "skewness", "kurtosis")


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """column, n_unique (a null counts as a value), rows, problem_type."""
    kind = df.schema[target].dataType
    distinct = df.groupBy(E.q(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    found = distinct.agg(F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("_t").alias("_values"))
    whole = isinstance(kind, T.IntegralType)
    rule = (
        F.lit("classification")
        if not isinstance(kind, T.NumericType)
        else F.when((F.col("n_unique") < 0.05 * F.col("rows")) | (F.lit(whole) & (F.col("_values") <= 20)), "classification").otherwise("regression")
    )
    return found.select(F.lit(target).alias("column"), "n_unique", "rows", rule.alias("problem_type"))


def detect_target(df: DataFrame, target: str | None = None) -> str:
    """The given target; else the best of: a telling name (10), boolean (8), two values (7), the last column (5)."""
    if target:
        if target not in df.columns:
            raise ValueError(f"no column {target}")
        return target
    binary = {r["column"] for r in binary_columns(df, [c for c in E.comparable_columns(df)]).where("is_binary").collect()}

    def rank(i: int, f: T.StructField) -> int:
        if f.name.lower() in C.TARGET_NAMES:
            return 10
        if isinstance(f.dataType, T.BooleanType):
            return 8
        return 7 if f.name in binary else 5 if i == len(df.columns) - 1 else 0

    ranks = [rank(i, f) for i, f in enumerate(df.schema)]
    return df.columns[ranks.index(max(ranks))]
