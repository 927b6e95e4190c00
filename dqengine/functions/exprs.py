"""Column builders that the operators are put together from."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions import catalogs as C

WIDE = 200
"""Aggregates of one job; wider requests are split so that generated code stays compilable."""


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def comparable_columns(df: DataFrame) -> list[str]:
    """Columns that can be grouped by; maps can't."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """A numeric column as double, NaN as null."""
    c = q(name).cast("double")
    return F.when(~F.isnan(c), c)


def finite(name: str) -> Column:
    c = number(name)
    return F.when(F.abs(c) < float("inf"), c)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), digits), F.lit(0.0))


def tidy(df: DataFrame, columns: list[str], metrics: dict[str, Callable[[str], Column]], kinds: str = "double") -> DataFrame:
    """One row per column with the given aggregates, from one scan for every WIDE of them."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{m} {kinds}" for m in metrics))
    step = max(1, WIDE // len(metrics))
    made = []
    for i in range(0, len(columns), step):
        rows = [F.struct(F.lit(c).alias("column"), *[f(c).alias(m) for m, f in metrics.items()]) for c in columns[i : i + step]]
        made.append(df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows")))
    return reduce(DataFrame.unionByName, made)


def adjusted_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for constants, null below three values."""
    n, v = F.count(c), F.var_pop(c)
    g = F.skewness(c) * F.sqrt((n * (n - 1)).cast("double"))
    return F.when(n < 3, F.lit(None)).when(v == 0, F.lit(0.0)).otherwise(F.try_divide(g, (n - 2).cast("double")))


def adjusted_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for constants, null below four values."""
    n, v = F.count(c).cast("double"), F.var_pop(c)
    g = F.try_divide((n - 1) * ((n + 1) * F.kurtosis(c) + 6), (n - 2) * (n - 3))
    return F.when(n < 4, F.lit(None)).when(v == 0, F.lit(0.0)).otherwise(g)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over rows that have both; null where either is constant there."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


QUARTILES = (0.25, 0.5, 0.75)


def sketched_quartile(c: Column, i: int) -> Column:
    """The i-th quartile (1 to 3), its rank off by a ten-thousandth of the rows at most. All three of a column are one aggregate."""
    return F.percentile_approx(c, list(QUARTILES), 10_000)[i - 1].cast("double")


def normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def starts(c: Column, *patterns: str) -> Column:
    """Whether the text begins with any of the patterns."""
    return c.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def is_numeric(c: Column) -> Column:
    s = F.trim(c)
    return s.rlike(f"^(?:{C.NUMERIC})$") | F.lower(s).isin(C.NUMERIC_WORDS)


def is_number_word(c: Column) -> Column:
    return normal(c).isin(C.NUMBER_WORDS) | starts(normal(c), C.ORDINAL)


def value_class(c: Column) -> Column:
    """numeric, text_numeric, boolean_like, datetime_like or categorical; the first that fits."""
    return (
        F.when(is_numeric(c), "numeric")
        .when(is_number_word(c), "text_numeric")
        .when(normal(c).isin(C.BOOLEAN_TOKENS), "boolean_like")
        .when(starts(F.trim(c), *C.DATETIME_STARTS), "datetime_like")
        .otherwise("categorical")
    )


def is_null_noise(c: Column) -> Column:
    return normal(c).isin(C.NULL_TOKENS)


def is_placeholder(c: Column) -> Column:
    return starts(normal(c), *C.PLACEHOLDERS)


def is_encoding_noise(c: Column) -> Column:
    return c.contains("�") | c.contains("\\x") | c.contains("\\u") | c.rlike(C.ENTITY)


def parse_date(c: Column) -> Column:
    """A timestamp by the fixed list of formats, else null. A format is tried on texts that have all its marks: a failed attempt is slow."""
    marked = lambda f: reduce(lambda x, y: x & y, [F.contains(c, F.lit(m)) for m in sorted(set(re.findall("[^A-Za-z']", f)))])
    return F.coalesce(*[F.when(marked(f), F.try_to_timestamp(c, F.lit(f))) for f in C.DATE_PARSE_FORMATS])
