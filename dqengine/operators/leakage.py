"""Target leakage: telling names, features that give the target away, dates that can't be."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions import catalogs as C
from dqengine.functions import exprs as E


def _plain(name: str) -> str:
    return name.lower().replace("_", "").replace(" ", "")


def name_hits(columns: list[str], custom: dict[str, list[str]] | None = None) -> list[dict]:
    """Columns whose name is, or holds, a name of the catalog; custom patterns are parts of names at medium risk."""
    found = []
    for column in columns:
        own = _plain(column)
        for category, names in C.LEAK_NAMES.items():
            for name in names:
                if _plain(name) in own:
                    found.append({"column": column, "category": category, "pattern": name, "match": "exact" if _plain(name) == own else "partial", "risk": C.LEAK_RISK[category]})
        for category, names in (custom or {}).items():
            found += [{"column": column, "category": category, "pattern": n, "match": "custom", "risk": "medium"} for n in names if n.lower() in column.lower()]
    return found


def name_hits_table(df: DataFrame, custom: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(h["column"], h["category"], h["pattern"], h["match"], h["risk"]) for h in name_hits(df.columns, custom)]
    return df.sparkSession.createDataFrame(rows, "column string, category string, pattern string, match string, risk string")


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """column, r, leak: features whose correlation with a numeric target is at least 0.95 (near) or 0.99 (perfect)."""
    features = [c for c in E.numeric_columns(df) if c != target]
    found = E.tidy(df, features, {"r": lambda c: F.round(E.safe_corr(E.finite(c), E.finite(target)), 4)})
    size = F.abs("r")
    return found.where(size >= 0.95).withColumn("leak", F.when(size >= 0.99, "perfect").otherwise("near"))


def perfect_predictors(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """column, ratio: share of all rows whose feature value goes with one class only. The pairs of all features are counted in
    one shuffle."""
    features = [c for c in (columns or E.comparable_columns(df)) if c != target]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), E.q(c).cast("string").alias("value")) for c in features])
    pairs = df.select(F.explode(cells).alias("_c"), E.q(target).cast("string").alias("_t")).groupBy("_c.column", "_c.value", "_t").agg(F.count(F.lit(1)).alias("_n"))
    by_value = pairs.groupBy("column", "value").agg(F.count("_t").alias("_k"), F.sum("_n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_t").isNotNull(), F.col("_n"))), F.lit(0)).alias("_known"))
    alone = F.sum(F.when(F.col("value").isNotNull() & (F.col("_k") == 1), F.col("_known")).otherwise(0))
    return by_value.groupBy("column").agg(F.try_divide(alone.cast("double"), F.sum("_all")).alias("ratio"))


def predictor_leaks(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """column, ratio, leak, risk: at least half (perfect, high) or a fifth (near, medium) of the rows."""
    found = perfect_predictors(df, target, columns).where("ratio >= 0.2")
    return found.select("column", "ratio", F.when(F.col("ratio") >= 0.5, "perfect").otherwise("near").alias("leak"), F.when(F.col("ratio") >= 0.5, "high").otherwise("medium").alias("risk"))


def _as_time(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    return E.q(column).cast("timestamp_ntz") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else E.parse_date(E.q(column).cast("string")).cast("timestamp_ntz")


def future_dates(df: DataFrame, as_of: datetime) -> DataFrame:
    """column, future, future_pct: values after ``as_of`` in date columns and those called so."""
    names = [c for c in df.columns if c in E.temporal_columns(df) or ("date" in c.lower() and c in E.string_columns(df))]
    late = lambda c: F.count_if(_as_time(df, c) > F.lit(as_of).cast("timestamp_ntz"))
    found = E.tidy(df, names, {"future": lambda c: late(c).cast("double"), "future_pct": lambda c: E.percent(late(c), F.count(F.lit(1)))})
    return found.where("future > 0")


def temporal_order(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """early, late, violations, valid, violation_pct for pairs of columns whose names hold the pair's names."""
    named = []
    for a, b in pairs or C.DATE_PAIRS:
        x, y = (next((c for c in df.columns if n in c.lower()), None) for n in (a, b))
        if x and y:
            named.append((x, y))
    if not named:
        return df.sparkSession.createDataFrame([], "early string, late string, violations long, valid long, violation_pct double")

    def row(a: str, b: str):
        x, y = _as_time(df, a), _as_time(df, b)
        wrong, valid = F.count_if(x > y), F.count_if(x.isNotNull() & y.isNotNull())
        return F.struct(F.lit(a).alias("early"), F.lit(b).alias("late"), wrong.alias("violations"), valid.alias("valid"), E.percent(wrong, valid).alias("violation_pct"))

    return df.agg(F.array(*[row(a, b) for a, b in named]).alias("_r")).select(F.inline("_r"))


@dataclass
class Leakage:
    names: list[dict] = field(default_factory=list)
    statistical: list[dict] = field(default_factory=list)
    future: list[dict] = field(default_factory=list)
    order: list[dict] = field(default_factory=list)

    def risks(self, compat: bool = False) -> dict[str, str]:
        """Highest risk of each column that is listed; in compat mode dates and custom names are not."""
        found: dict[str, str] = {}
        rank = {"low": 0, "medium": 1, "high": 2}
        rows = [(h["column"], h["risk"]) for h in self.names if not (compat and h["match"] == "custom")]
        rows += [(h["column"], h["risk"]) for h in self.statistical if not (compat and h["column"] in {r[0] for r in rows})]
        if not compat:
            rows += [(h["column"], "medium") for h in self.future] + [(h["early"], "low") for h in self.order]
        for column, risk in rows:
            if column not in found or rank[risk] > rank[found[column]]:
                found[column] = risk
        return found

    def overall(self, compat: bool = False) -> str:
        risks = set(self.risks(compat).values())
        return "high" if "high" in risks else "medium" if "medium" in risks else "low"

    def recommendations(self) -> list[str]:
        risks = self.risks()
        said = []
        for level, text in (("high", "Remove, or show that they are known before the prediction"), ("medium", "Check how and when these come to be")):
            columns = [c for c, r in risks.items() if r == level][:5]
            if columns:
                said.append(f"{text}: {', '.join(columns)}")
        return said or ["No leakage found"]


def check(df: DataFrame, target: str | None, as_of: datetime, custom: dict[str, list[str]] | None = None, compat: bool = False) -> Leakage:
    """All leakage rules. Outside compat mode the target's own name doesn't count against it."""
    names = [h for h in name_hits(df.columns, custom) if compat or h["column"] != target]
    found = Leakage(names=names)
    if target:
        if isinstance(df.schema[target].dataType, T.NumericType):
            found.statistical = [{"column": r["column"], "risk": "high" if r.leak == "perfect" else "medium"} for r in target_correlations(df, target).collect()]
        else:
            found.statistical = [{"column": r["column"], "risk": r.risk} for r in predictor_leaks(df, target).collect()]
    found.statistical.sort(key=lambda h: h["column"])
    found.future = [r.asDict() for r in future_dates(df, as_of).collect()]
    found.order = [r.asDict() for r in temporal_order(df).where("violations > 0").collect()]
    return found
