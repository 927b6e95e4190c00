"""The telling rows of a table: at most fifty, for what they show, in a number of jobs that doesn't depend on the columns.

Facts come first (values that fill half a column, pairs of columns that are missing together, fences, thirds of a time column). Then one
pass turns each row into a cell for every rule that it meets, and keeps the first few cells of each rule, column and part. That is a
row number with a bound, which Spark applies within tasks before it shuffles: no task gets more of a rule than the bound from each
other one. What is left is some hundred keys, whatever the rows; quotas and the rows themselves are worked out from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions import catalogs as C
from dqengine.functions import exprs as E
from dqengine.operators import profile, sampling
from dqengine.operators.quantiles import order_statistics

# Rule: severity, quota, rows of each part, parts that a column needs at least.
RULES = {
    "mixed_types": ("CRITICAL", "critical", 2, 2),
    "semantic_nulls": ("CRITICAL", "critical", 3, 1),
    "dominant_value": ("CRITICAL", "critical", 1, 1),
    "date_formats": ("HIGH", "high", 1, 2),
    "number_formats": ("MEDIUM", "high", 1, 2),
    "many_missing": ("MEDIUM", "high", 3, 1),
    "missing_together": ("MEDIUM", "high", 1, 1),
    "blank_text": ("MEDIUM", "high", 2, 1),
    "outlier": ("MEDIUM", "medium", 1, 1),
    "temporal": ("LOW", "temporal", 3, 1),
    "spread": ("LOW", "temporal", 5, 1),
    "baseline": ("LOW", "baseline", 5, 1),
}
TOGETHER_PCT = 20.0
OUTLIER_PCT = 5.0
PER_TYPE = 3
"""Rows of a type that may repeat a type, column and severity."""


def _cells(df: DataFrame, key: str, seed: int) -> list[tuple[str, str | None, Column, Column, Column]]:
    """(rule, column, part or null where the rule isn't met, order, draw)."""
    zero, none, draw = F.lit(0.0), F.lit(""), sampling.draw(key, seed)
    texts = [c for c in E.string_columns(df) if c != key]
    made = []

    def rule(name: str, column: str | None, part: Column, order: Column = zero, by: Column = none) -> None:
        made.append((name, column, part, order, by))

    dominant = {r["column"]: r.value for r in profile.dominant_values(df, texts).collect()}  # one value a column at most
    for c in texts:
        text = E.q(c).cast("string")
        trimmed = F.trim(text)
        like_null = F.lower(F.coalesce(text, F.lit("nan")))
        rule("mixed_types", c, F.when(text.isNotNull(), F.when(E.is_numeric(text), "numeric").otherwise("other")))
        rule("semantic_nulls", c, F.when(F.exists(F.array(*map(F.lit, C.SAMPLE_NULL_PARTS)), lambda p: F.contains(like_null, p)), ""))
        if c in dominant:
            rule("dominant_value", c, F.when(text == dominant[c], ""))
        rule("date_formats", c, sampling.date_kind(trimmed))
        rule("number_formats", c, sampling.number_kind(trimmed))
        rule("blank_text", c, F.when(trimmed == "", ""))
    gone = sampling.missing_per_row(df)
    rule("many_missing", None, F.when(gone >= max(2.0, 0.3 * len(df.columns)), ""))
    place = df.columns.index
    for a, b in sorted(((r.column_a, r.column_b) for r in profile.co_missing(df, TOGETHER_PCT).collect()), key=lambda p: (place(p[0]), place(p[1]))):
        rule("missing_together", f"{a}, {b}", F.when(profile.is_missing(df, a) & profile.is_missing(df, b), ""))
    for r in profile.outliers(df, [c for c in E.numeric_columns(df) if c != key]).where(F.col("outlier_pct") > OUTLIER_PCT).collect():
        x = E.number(r["column"])
        rule("outlier", r["column"], F.when(x < r.lower, "low"), x)
        rule("outlier", r["column"], F.when(x > r.upper, "high"), -x)
    time = sampling.temporal_column(df, key)
    third = None
    if time:
        when = E.q(time).cast("timestamp") if time in E.temporal_columns(df) else E.parse_date(E.q(time))
        seconds = F.unix_micros(when.cast("timestamp")).cast("double")
        cuts = order_statistics(df.select(seconds.alias("t")), ["t"], (1 / 3, 2 / 3)).get("t")
        n = df.where(when.isNotNull()).count()
        if n > 10:
            third = F.when(seconds < cuts[0], "early").when(seconds > cuts[1], "late").when(seconds.isNotNull(), "middle")
    if third is not None:
        rule("temporal", time, third, by=draw)
    else:
        rule("spread", None, F.lit(""), by=sampling.draw(key, seed + 1))
    rule("baseline", None, F.lit(""), gone.cast("double"), draw)
    return made


def telling_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """place, issue_type, column, severity, part and the key of each row, in order of rules and columns.

    ``key`` tells rows apart and orders them. A type, column and severity comes once, and again while its type has fewer than ``PER_TYPE``
    rows; quotas of ``sampling.BUDGET`` hold for critical rows, formats and missing values, outliers, times and baseline each. Baseline
    rows are five complete ones, or else the three that miss least. Thirds of a time column are cut between its values, so equal times
    stay together. An empty table has no rows."""
    cells = _cells(df, key, seed)
    names = list(RULES)
    each = [
        F.when(part.isNotNull(), F.struct(F.lit(i).alias("cell"), part.alias("part"), order.alias("ord"), by.alias("draw"))) for i, (_, _, part, order, by) in enumerate(cells)
    ]
    met = df.select(E.q(key).alias("_key"), F.explode(F.array(*each)).alias("_c")).where("_c is not null").select("_key", "_c.*")
    most = max(k for _, _, k, _ in RULES.values())
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("cell", "part").orderBy("ord", "draw", "_key"))).where(F.col("r") <= most)
    about = df.sparkSession.createDataFrame(
        [(i, names.index(n), n, c, *RULES[n]) for i, (n, c, *_) in enumerate(cells)],
        "cell int, rule int, issue_type string, column string, severity string, quota string, rows int, parts int",
    )
    # From here on there are at most some rows for each rule, column and part.
    picked = ranked.join(F.broadcast(about), "cell").where(F.col("r") <= F.col("rows"))
    of = Window.partitionBy("cell")
    picked = picked.withColumn("found", F.size(F.collect_set("part").over(of))).where(F.col("found") >= F.col("parts"))
    complete = F.count_if(F.col("ord") == 0).over(of) == RULES["baseline"][2]
    picked = picked.withColumn("complete", complete)
    picked = picked.where((F.col("issue_type") != "baseline") | F.col("complete") | (F.col("r") <= 3))
    order = ["rule", "cell", "part", "r"]
    first = F.row_number().over(Window.partitionBy("issue_type", "column", "severity").orderBy(*order)) == 1
    kept = picked.withColumn("first", first).withColumn("of_type", F.row_number().over(Window.partitionBy("issue_type").orderBy(*order))).where(F.col("first") | (F.col("of_type") <= PER_TYPE))
    left = F.element_at(F.create_map(*[F.lit(x) for kv in sampling.BUDGET.items() for x in kv]), F.col("quota"))
    kept = kept.withColumn("in_quota", F.row_number().over(Window.partitionBy("quota").orderBy(*order))).where(F.col("in_quota") <= left)
    return kept.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "issue_type", "column", "severity", "part", F.col("_key").alias(key))


def with_rows(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Telling rows with the whole row as a struct: fifty keys are broadcast to one scan."""
    whole = df.select(E.q(key).alias("_key"), F.struct(*[E.q(c) for c in df.columns]).alias("row"))
    return whole.join(F.broadcast(rows), F.col("_key").eqNullSafe(E.q(key))).drop("_key")


def samples(df: DataFrame, key: str, seed: int = 42, compat: bool = False) -> list[dict]:
    """Telling rows as {issue_type, column, severity, row}, in order: at most fifty. ``compat`` leaves out those that are neither severe
    nor there for comparison."""
    found = with_rows(df, telling_rows(df, key, seed), key).orderBy("place").collect()
    rows = [{"issue_type": r.issue_type, "column": r["column"], "severity": r.severity, "row": r["row"].asDict()} for r in found]
    return [r for r in rows if not compat or r["severity"] != "MEDIUM"]
