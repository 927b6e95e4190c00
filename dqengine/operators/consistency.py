"""Rules about strings: mixed types, noise, units, formats, abbreviations and spellings.

All rules read one table of distinct values (column, value, n): a single shuffle serves every column and every rule, and counts
of distinct noise values are plain counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions import catalogs as C
from dqengine.functions import exprs as E
from dqengine.operators.profile import value_counts

CLASSES = ["numeric", "text_numeric", "boolean_like", "datetime_like", "categorical"]


def head_sample(df: DataFrame, column: str, n: int, order: str) -> DataFrame:
    """The first n non-null values of a column in the given order."""
    return df.where(E.q(column).isNotNull()).orderBy(E.q(order)).limit(n)


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return value_counts(df, columns).where("value is not null")


def type_class_histogram(values: DataFrame) -> DataFrame:
    """column, type_class, n."""
    return values.groupBy("column", E.value_class(F.col("value")).alias("type_class")).agg(F.sum("n").alias("n"))


def mixed_types(values: DataFrame) -> DataFrame:
    """column, classes, semantic_mixing (numbers and number words), severity of columns with more than one class."""
    h = type_class_histogram(values)
    both = (F.count_if(F.col("type_class") == "numeric") > 0) & (F.count_if(F.col("type_class") == "text_numeric") > 0)
    found = h.groupBy("column").agg(F.count(F.lit(1)).alias("classes"), both.alias("semantic_mixing")).where("classes > 1")
    return found.withColumn("severity", F.when(F.col("semantic_mixing"), "high").otherwise("medium"))


def noise(values: DataFrame) -> DataFrame:
    """column, distinct null-like, placeholder and encoding-damaged values, their share of rows and its severity."""
    v = F.col("value")
    per = values.groupBy("column", E.normal(v).alias("_norm")).agg(
        F.sum("n").alias("_n"), F.max(E.is_null_noise(v).cast("int")).alias("_a"), F.max(E.is_placeholder(v).cast("int")).alias("_b"), F.sum(E.is_encoding_noise(v).cast("int")).alias("_c")
    )
    found = per.groupBy("column").agg(F.sum("_n").alias("rows"), F.sum("_a").alias("null_noise"), F.sum("_b").alias("placeholder_noise"), F.sum("_c").alias("encoding_noise"))
    share = E.percent(F.col("null_noise") + F.col("placeholder_noise") + F.col("encoding_noise"), F.col("rows"))
    return found.withColumn("noise_pct", share).withColumn("severity", F.when(share > 10, "high").otherwise("medium")).where("noise_pct > 0")


def noise_values(values: DataFrame) -> DataFrame:
    """column, kind, value (lower, trimmed), n."""
    v = F.col("value")
    kinds = F.array_compact(F.array(F.when(E.is_null_noise(v), "null"), F.when(E.is_placeholder(v), "placeholder"), F.when(E.is_encoding_noise(v), "encoding")))
    return values.select("column", F.explode(kinds).alias("kind"), E.normal(v).alias("value"), "n").groupBy("column", "kind", "value").agg(F.sum("n").alias("n"))


def _pattern_counts(values: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """column, family, pattern, n from (family, name, regex); patterns that nothing matches are left out."""
    hits = F.array_compact(F.array(*[F.when(F.col("value").rlike(regex), F.struct(F.lit(family).alias("family"), F.lit(name).alias("pattern"))) for family, name, regex in patterns]))
    return values.select("column", F.explode(hits).alias("_h"), "n").groupBy("column", "_h.family", "_h.pattern").agg(F.sum("n").alias("n"))


def unit_patterns(values: DataFrame) -> DataFrame:
    """column, family, pattern, n: values that hold a unit pattern, in any case."""
    return _pattern_counts(values, [(family, p, f"(?i){p}") for family, patterns in C.UNITS.items() for p in patterns])


def unit_inconsistencies(values: DataFrame) -> DataFrame:
    """column, family, patterns of families with two or more patterns."""
    return unit_patterns(values).groupBy("column", "family").agg(F.count(F.lit(1)).alias("patterns")).where("patterns > 1")


def date_formats(values: DataFrame) -> DataFrame:
    return _pattern_counts(values, [("date", name, f"^(?:{p})") for name, p in C.DATE_FORMATS.items()])


def phone_formats(values: DataFrame) -> DataFrame:
    return _pattern_counts(values, [("phone", name, f"^(?:{p})") for name, p in C.PHONE_FORMATS.items()])


def format_inconsistencies(values: DataFrame) -> DataFrame:
    """column, family, formats, severity: several date formats (medium), else several phone formats (low)."""
    found = date_formats(values).unionByName(phone_formats(values)).groupBy("column", "family").agg(F.count(F.lit(1)).alias("formats")).where("formats > 1")
    first = found.groupBy("column").agg(F.min(F.struct("family", "formats")).alias("_f"))
    return first.select("column", "_f.family", "_f.formats", F.when(F.col("_f.family") == "date", "medium").otherwise("low").alias("severity"))


def abbreviation_pairs(values: DataFrame) -> DataFrame:
    """column, abbreviation, expansion: the abbreviation is a value and the expansion is part of another."""
    norm = E.normal(F.col("value"))
    pairs = [(a, x) for a, many in C.ABBREVIATIONS.items() for x in many]
    flags = F.array(*[F.struct(F.lit(a).alias("abbreviation"), F.lit(x).alias("expansion"), (F.count_if(norm == a) > 0).alias("_a"), (F.count_if(norm.contains(x) & (norm != a)) > 0).alias("_x")) for a, x in pairs])
    return values.groupBy("column").agg(flags.alias("_f")).select("column", F.inline("_f")).where("_a and _x").select("column", "abbreviation", "expansion")


def spelling_variants(values: DataFrame) -> DataFrame:
    """column, value (lower, trimmed), variants: several spellings differ in case or outer spaces only."""
    return values.groupBy("column", E.normal(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def examples(df: DataFrame, column: str, order: str) -> DataFrame:
    """kind, value: the first two numbers and the first two other texts of a column. Ranks are cut within tasks."""
    s = df.select(E.q(column).cast("string").alias("value"), E.q(order).alias("_o")).where("value is not null")
    s = s.withColumn("kind", F.when(E.is_numeric(F.col("value")), "numeric").otherwise("text"))
    w = Window.partitionBy("kind").orderBy("_o")
    return s.withColumn("_r", F.row_number().over(w)).where("_r <= 2").select("kind", "value")


@dataclass
class Consistency:
    """Issues by kind: column -> severity or detail; and the score that follows."""

    mixed: dict[str, str] = field(default_factory=dict)
    noise: dict[str, str] = field(default_factory=dict)
    categorical: set[str] = field(default_factory=set)
    units: set[str] = field(default_factory=set)
    formats: dict[str, str] = field(default_factory=dict)

    @property
    def score(self) -> float:
        lost = sum(20 if s == "high" else 10 for s in self.mixed.values()) + sum(15 if s == "high" else 8 for s in self.noise.values())
        return max(0.0, 100.0 - lost - 8 * len(self.categorical) - 5 * len(self.units) - 3 * len(self.formats))

    def recommendations(self) -> list[str]:
        said = [
            (self.mixed, "Bring mixed columns to one type"),
            (self.noise, "Turn null-like, placeholder and damaged texts into nulls"),
            (self.categorical, "Use one spelling for each category"),
            (self.units, "Use one unit in each column"),
            (self.formats, "Use one date or phone format in each column"),
        ]
        return [f"{text}: {', '.join(sorted(columns))}" for columns, text in said if columns]


def check(df: DataFrame, compat: bool = False) -> Consistency:
    """All rules over all string columns. ``compat`` leaves out the spelling variants."""
    values = distinct_values(df).persist()
    try:
        severities = lambda rows: {r["column"]: r.severity for r in rows.collect()}
        columns = lambda rows: {r["column"] for r in rows.select("column").distinct().collect()}
        categories = columns(abbreviation_pairs(values)) | (set() if compat else columns(spelling_variants(values)))
        return Consistency(severities(mixed_types(values)), severities(noise(values)), categories, columns(unit_inconsistencies(values)), severities(format_inconsistencies(values)))
    finally:
        values.unpersist()
