"""Issues, preprocessing steps and readiness notes that follow from the evidence."""

from __future__ import annotations

from dqengine.plans.scoring import Evidence, first_above


def detected(e: Evidence) -> list[dict]:
    found: list[dict] = []

    def add(severity: str, category: str, title: str, recommendation: str, columns: list[str] = ()) -> None:
        found.append({"severity": severity, "category": category, "title": title, "affected_columns": list(columns), "recommendation": recommendation})

    if e.missing_pct > 5:
        add("high" if e.missing_pct > 20 else "medium", "missing_data", f"{e.missing_pct:g}% of all values are missing", "Impute or drop", [c for c, p in e.missing_by_column.items() if p > 0])
    if e.duplicate_pct > 5:
        add("medium" if e.duplicate_pct > 10 else "low", "duplicates", f"{e.duplicate_pct:g}% of the rows are duplicates", "Drop duplicates")
    if not e.balanced:
        add("high" if e.imbalance > 10 else "medium", "class_imbalance", f"Classes differ by a factor of {e.imbalance:.1f}", "Weight or resample the classes", [e.target] if e.target else [])
    if e.high_pairs:
        add("medium", "correlation", f"{e.high_pairs} pairs of columns are highly correlated", "Drop or combine columns")
    if e.high_cardinality:
        add("low", "high_cardinality", f"{e.high_cardinality} columns have over 50 categories", "Group or hash the categories")
    if e.low_variance:
        add("low", "low_variance", f"{e.low_variance} columns hardly vary", "Drop them")
    return found


def severity_counts(issues: list[dict]) -> dict[str, int]:
    return {s: sum(i["severity"] == s for i in issues) for s in ("high", "medium", "low")}


SNIPPETS = {
    "imputation": "Imputer(strategy='median', inputCols=columns, outputCols=columns).fit(df).transform(df)",
    "sampling": "df.withColumn('weight', when(col(target) == minority, ratio).otherwise(1.0))",
    "encoding": "OneHotEncoder(inputCols=indexed, outputCols=encoded)",
    "scaling": "StandardScaler(inputCol='features', outputCol='scaled', withMean=True)",
    "deduplication": "df.dropDuplicates()",
}


def preprocessing(e: Evidence) -> list[dict]:
    wanted = [
        (e.missing_pct > 0, "Fill missing values", "imputation", ["Simple Imputation", "KNN Imputation", "Iterative Imputation"]),
        (not e.balanced, "Balance the classes", "sampling", ["Class Weights", "SMOTE", "Random Oversampling"]),
        (e.categorical > 0, "Encode categories", "encoding", ["One-Hot Encoding", "Target Encoding", "Label Encoding"]),
        (e.numerical > 0, "Scale numbers", "scaling", ["Standard Scaling", "Robust Scaling", "Min-Max Scaling"]),
        (e.duplicate_pct > 5, "Drop duplicates", "deduplication", ["Drop Duplicates"]),
    ]
    steps = [{"step": step, "category": kind, "methods": methods, "code_snippet": SNIPPETS[kind]} for needed, step, kind, methods in wanted if needed]
    return [{"priority": i, **s} for i, s in enumerate(steps, 1)]


def size_category(rows: int) -> str:
    return next((name for bound, name in [(100, "very_small"), (1_000, "small"), (10_000, "medium"), (100_000, "large")] if rows < bound), "very_large")


def samples_per_feature(e: Evidence) -> float:
    return e.rows / max(1, e.columns - (1 if e.target else 0))


def complexity(e: Evidence) -> str:
    points = first_above(e.missing_pct, [(20, 3), (5, 2), (0, 1)]) + first_above(e.categorical, [(5, 2), (0, 1)]) + e.high_cardinality
    return "high" if points >= 6 else "medium" if points >= 3 else "low"


def readiness(e: Evidence) -> list[str]:
    notes = [
        (e.rows < 100, "too few rows"),
        (e.rows / max(1, e.columns) < 10, "few rows for so many columns"),
        (e.missing_pct > 30, "far too many missing values"),
        (15 < e.missing_pct <= 30, "many missing values"),
        (e.target_missing > 0, "the target has missing values"),
        (e.target is None, "no target"),
        (e.categorical > 0, "categories need encoding"),
    ]
    return [n for on, n in notes if on]


def suggested_steps(e: Evidence) -> list[str]:
    steps = [
        (e.missing_pct > 0, "impute missing values"),
        (e.categorical > 0, "encode categories"),
        (e.numerical > 1, "scale numbers"),
        (e.duplicate_pct > 0, "drop duplicates"),
        (e.imbalance > 5, "balance classes"),
    ]
    return [s for on, s in steps if on][:5]


def risk_factors(e: Evidence) -> list[tuple[str, str]]:
    per = e.rows / max(1, e.columns)
    risks = [("high" if per < 10 else "medium", "overfitting")] if per < 20 else []
    return risks + [("medium", "bias from missing values")] * (e.missing_pct > 20) + [("high", "more columns than rows")] * (e.columns > e.rows)
