"""Deterministic samples of telling rows. Order always comes from a column, random draws from a hash of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions import catalogs as C
from dqengine.functions import exprs as E
from dqengine.functions.lineage import cut
from dqengine.operators import profile

BUDGET = {"critical": 15, "high": 12, "temporal": 10, "medium": 7, "baseline": 6}


def time_thirds(df: DataFrame, time: str, key: str) -> DataFrame:
    """Rows with ``third``: early (the first n // 3 by time), middle, late (the last n // 3); none for ten rows or fewer."""
    dated = df.where(E.q(time).isNotNull())
    n = dated.count()
    if n <= 10:
        return dated.limit(0).withColumn("third", F.lit("early"))
    placed = positions(dated, [E.q(time), E.q(key)])
    third = F.when(F.col("_place") < n // 3, "early").when(F.col("_place") >= n - n // 3, "late").otherwise("middle")
    return placed.withColumn("third", third).drop("_place")


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``_place``, their position in the order, from 0: a range sort, written once, then counts of the partitions
    before; no task gets more than its range."""
    sorted_ = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    starts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("_part").alias("_p"), "_first", before.alias("_before"))
    return sorted_.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn("_place", F.col("_before") + F.col("_seq") - F.col("_first")).drop("_part", "_seq", "_p", "_first", "_before")


def thirds_sample(df: DataFrame, time: str, key: str, per_third: int = 3, seed: int = 42) -> DataFrame:
    thirds = time_thirds(df, time, key)
    parts = [thirds.where(F.col("third") == t).orderBy(draw(key, seed), E.q(key)).limit(per_third) for t in ("early", "middle", "late")]
    return reduce(DataFrame.unionByName, parts)


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), E.q(key).cast("string")))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed), E.q(key)).limit(n)


def stride_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """Every (rows // n)-th row in order of the key, n rows."""
    step = max(1, df.count() // n)
    return positions(df, [E.q(key)]).where((F.col("_place") % step == 0) & (F.col("_place") < step * n)).drop("_place")


def missing_per_row(df: DataFrame) -> Column:
    return sum((profile.is_missing(df, c).cast("int") for c in df.columns), F.lit(0))


def baseline_rows(df: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """n complete rows; if there are not that many, the three with the fewest missing values."""
    complete = seeded_sample(df.where(missing_per_row(df) == 0), n, key, seed)
    if complete.count() == n:
        return complete
    return df.orderBy(missing_per_row(df), draw(key, seed), E.q(key)).limit(3)


def missing_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows that miss at least max(2, 0.3 * columns) values."""
    return df.where(missing_per_row(df) >= max(2.0, 0.3 * len(df.columns))).orderBy(E.q(key)).limit(n)


def co_missing_rows(df: DataFrame, n: int, key: str, most_columns: int = 10) -> DataFrame:
    """Rows that miss both columns of a pair of which each misses more than a fifth; among the first columns."""
    names = df.columns[:most_columns]
    often = {r["column"] for r in profile.missing(df.select(*[E.q(c) for c in names])).where("missing_pct > 20").collect()}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if {a, b} <= often]
    wanted = reduce(lambda x, y: x | y, [profile.is_missing(df, a) & profile.is_missing(df, b) for a, b in pairs], F.lit(False))
    return df.where(wanted).orderBy(E.q(key)).limit(n)


def blank_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    wanted = reduce(lambda x, y: x | y, [F.trim(E.q(c)) == "" for c in E.string_columns(df)], F.lit(False))
    return df.where(wanted).orderBy(E.q(key)).limit(n)


def null_like_rows(df: DataFrame, column: str, key: str, n: int = 3) -> DataFrame:
    """Rows whose value holds a null-like part (a null reads 'nan')."""
    value = F.lower(F.coalesce(E.q(column).cast("string"), F.lit("nan")))
    return df.where(reduce(lambda x, y: x | y, [value.contains(p) for p in C.SAMPLE_NULL_PARTS])).orderBy(E.q(key)).limit(n)


def mixed_rows(df: DataFrame, column: str, key: str, n: int = 2) -> DataFrame:
    """The first rows of each class of a column that mixes numbers with other texts."""
    numeric = E.is_numeric(E.q(column).cast("string"))
    sides = [df.where(E.q(column).isNotNull() & c).orderBy(E.q(key)).limit(n) for c in (numeric, ~numeric)]
    return sides[0].unionByName(sides[1]) if not any(s.isEmpty() for s in sides) else df.limit(0)


def dominant_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """The first row with a value that covers over half of the column."""
    found = profile.dominant_values(df, [column]).select("value").first()
    return df.where(E.q(column) == found.value).orderBy(E.q(key)).limit(1) if found else df.limit(0)


def date_kind(c: Column) -> Column:
    return F.when(c.rlike(r"\d{1,4}/\d{1,2}/\d{1,4}"), "slash").when(c.rlike(r"\d{1,4}-\d{1,2}-\d{1,4}"), "dash").when(c.rlike(r"\d{1,4}\.\d{1,2}\.\d{1,4}"), "dot")


def number_kind(c: Column) -> Column:
    return F.when(c.rlike("[$€£¥]"), "currency").when(c.rlike(r"^\d+\.?\d*$"), "plain").when(c.rlike(r"\d+[eE][+-]?\d+"), "scientific").when(c.contains("%") & c.rlike(r"\d"), "percentage")


def format_rows(df: DataFrame, column: str, key: str, kind=date_kind) -> DataFrame:
    """The first row of each format of a column, with ``format``, if there are two or more formats. Ranks are cut within tasks."""
    found = df.where(E.q(column).isNotNull()).withColumn("format", kind(F.trim(E.q(column)))).where("format is not null")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("format").orderBy(E.q(key)))).where("_r = 1").drop("_r")
    return first.withColumn("_formats", F.count(F.lit(1)).over(Window.partitionBy())).where("_formats >= 2").drop("_formats")  # one row a format


def outlier_rows(df: DataFrame, least_pct: float = 5.0, key: str = "_row_id") -> DataFrame:
    """column, end, and the most extreme row at each end of columns with more outliers than that; ties by key."""
    names = [r["column"] for r in profile.outliers(df).where(F.col("outlier_pct") > least_pct).collect()]
    parts = []
    for c in names:
        ends = df.where(E.number(c).isNotNull()).agg(F.min(F.struct(E.number(c).alias("v"), E.q(key).alias("k"))).alias("low"), F.min(F.struct((-E.number(c)).alias("v"), E.q(key).alias("k"))).alias("high"))
        parts.append(ends.select(F.lit(c).alias("column"), F.inline(F.array(F.struct(F.lit("low").alias("end"), F.col("low.v").alias("value"), F.col("low.k").alias("key")), F.struct(F.lit("high").alias("end"), (-F.col("high.v")).alias("value"), F.col("high.k").alias("key"))))))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "column string, end string, value double, key long")


def parsing_columns(df: DataFrame, least: float = 0.5) -> list[str]:
    """String columns of whose values more than ``least`` parse as dates."""
    counts = profile.value_counts(df, E.string_columns(df)).where("value is not null")  # each distinct value is parsed once
    dates = F.sum(F.when(E.parse_date(F.col("value")).isNotNull(), F.col("n")).otherwise(0))
    share = F.try_divide(dates.cast("double"), F.sum("n"))
    parsed = {r["column"] for r in counts.groupBy("column").agg(share.alias("share")).where(F.col("share") > least).collect()}
    return [c for c in E.string_columns(df) if c in parsed]


def temporal_column(df: DataFrame, key: str | None = None) -> str | None:
    """The first date column, else the first string column that is called like one, else (with a key) the first one that parses."""
    found = E.temporal_columns(df)
    named = [c for c in E.string_columns(df) if any(h in c.lower() for h in C.TEMPORAL_HINTS)]
    return (found or named or (parsing_columns(df) if key else []) or [None])[0]


def stratified(df: DataFrame, key: str, seed: int = 42, compat: bool = False) -> list[dict]:
    """At most 50 rows as {issue_type, column, severity, row}. A type, column and severity comes once, until its type has three."""
    found: list[dict] = []

    def add(rows: DataFrame, kind: str, column: str | None, severity: str) -> None:
        found.extend({"issue_type": kind, "column": column, "severity": severity, "row": r.asDict()} for r in rows.limit(5).collect())

    for c in E.string_columns(df):
        add(mixed_rows(df, c, key), "mixed_types", c, "CRITICAL")
        add(null_like_rows(df, c, key), "semantic_nulls", c, "CRITICAL")
        add(dominant_rows(df, c, key), "dominant_value", c, "CRITICAL")
        add(format_rows(df, c, key), "date_formats", c, "HIGH")
        add(format_rows(df, c, key, number_kind), "number_formats", c, "MEDIUM")
    add(missing_rows(df, BUDGET["medium"], key), "many_missing", None, "MEDIUM")
    add(co_missing_rows(df, BUDGET["medium"], key), "missing_together", None, "MEDIUM")
    add(blank_rows(df, BUDGET["medium"], key), "blank_text", None, "MEDIUM")
    for r in outlier_ends(df, key):
        add(df.where(E.q(key) == r["key"]), "outlier", r["column"], "MEDIUM")
    if compat:
        found = [x for x in found if x["severity"] in ("CRITICAL", "HIGH")]
    if time := temporal_column(df, key):
        dated = df if time in E.temporal_columns(df) else df.withColumn(time, E.parse_date(E.q(time)))
        add(thirds_sample(dated, time, key, seed=seed), "temporal", time, "LOW")
    add(baseline_rows(df, key, seed=seed), "baseline", None, "LOW")
    if not any(x["issue_type"] == "temporal" for x in found):
        add(stride_sample(df, 5, key), "spread", None, "LOW")
    return limited(found)


def outlier_ends(df: DataFrame, key: str) -> list[dict]:
    """column and key of the most extreme rows of columns with many outliers."""
    numbers = [c for c in E.numeric_columns(df) if c != key]
    return [r.asDict() for r in outlier_rows(df.select(*[E.q(c) for c in numbers], E.q(key)), key=key).collect() if r["column"] != key]


def limited(rows: list[dict]) -> list[dict]:
    kept, seen, types = [], set(), {}
    left = {"CRITICAL": BUDGET["critical"], "HIGH": BUDGET["high"], "MEDIUM": BUDGET["medium"], "LOW": BUDGET["temporal"] + BUDGET["baseline"]}
    for r in rows:
        mark = (r["issue_type"], r["column"], r["severity"])
        if left[r["severity"]] > 0 and (mark not in seen or types.get(r["issue_type"], 0) < 3):
            seen.add(mark)
            types[r["issue_type"]] = types.get(r["issue_type"], 0) + 1
            left[r["severity"]] -= 1
            kept.append(r)
    return kept


def summary(rows: list[dict]) -> dict[str, int]:
    return {"total": len(rows), **{f"{s.lower()}_count": sum(r["severity"] == s for r in rows) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}}

