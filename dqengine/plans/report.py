"""analyze(): from a table to one nested report, with every part computed once."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.functions import exprs as E
from dqengine.operators import baseline, consistency, importance, leakage, neighbours, profile, sampling, sketches, telling, validation
from dqengine.plans import assess, issues, models, scoring
from dqengine.sources import tables, workbook

SCHEMA = """
analysis_id string, timestamp timestamp,
dataset_info struct<filename string, rows long, columns int, size_mb double, detected_problem_type string, detected_target_column string>,
quality_score struct<overall double, grade string, breakdown map<string, struct<score double, grade string, description string>>>,
data_profile struct<missing_pct double, duplicate_rows long, duplicate_pct double, column_types map<string, int>, numeric_summary map<string, double>, categorical_summary map<string, double>,
  missing map<string, double>, outliers map<string, struct<outliers long, outlier_pct double, lower double, upper double>>, high_correlations array<struct<column_a string, column_b string, r double>>,
  numeric_features map<string, struct<variance double, low_variance boolean, n_unique long>>, categorical_features map<string, struct<n_unique long, cardinality string, mode string, mode_count long>>,
  leakage struct<risk string, columns map<string, string>, recommendations array<string>>, consistency struct<score double, columns map<string, array<string>>, recommendations array<string>>>,
detected_issues array<struct<severity string, category string, title string, affected_columns array<string>, recommendation string>>,
model_recommendations array<struct<rank int, model_name string, confidence_score double, reasoning string>>,
preprocessing_recommendations array<struct<priority int, step string, category string, methods array<string>, code_snippet string>>,
insights struct<summary string, red_flags array<string>, action_items array<struct<action string, impact string, effort string>>, pipeline string>,
processing_seconds double
"""


ADVICE = 3
"""Recommendations of a rule set that the report shows."""


PARTS = frozenset({"duplicates", "missing", "classes", "outliers", "correlations", "categories", "numbers", "consistency", "target"})
"""What evidence is made of."""


def gather(df: DataFrame, target: str | None, problem: str | None, as_of: datetime, with_model: bool = True, compat: bool = False, exact: bool = True, parts: frozenset[str] = PARTS) -> scoring.Evidence:
    """The evidence, in a number of jobs that doesn't depend on the number of columns; ``parts`` names what is wanted of it.
    ``exact=False`` takes missing values, duplicates, quartiles, distinct and most frequent values from sketches, whose memory doesn't
    grow with the rows."""
    e = scoring.Evidence(columns=len(df.columns), target=target, problem=problem)
    state = {} if exact else {r["column"]: r for r in sketches.read(sketches.sketch(df), 1).collect()}
    if not exact:
        e.rows, distinct = df.agg(F.count(F.lit(1)), sketches.distinct_rows(df)).first()
        # Within the sketch's own error there are no duplicates.
        e.details["duplicate_rows"] = more = e.rows - distinct if e.rows - distinct > sketches.DISTINCT_ERROR * e.rows else 0
        e.duplicate_pct = round(100 * more / max(1, e.rows), 2)
    elif "duplicates" in parts:
        d = profile.duplicates(df).first()
        e.rows, e.duplicate_pct = d.rows, d.duplicate_pct
        e.details["duplicate_rows"] = d.duplicate_rows
    else:
        e.rows = df.count()
    if "missing" in parts:
        e.missing_by_column = {c: r.missing_pct for c, r in state.items() if r.missing} if state else {r["column"]: r.missing_pct for r in profile.missing(df).where("missing > 0").collect()}
        e.missing_pct = round(sum(e.missing_by_column.values()) / max(1, e.columns) + 1e-9, 2)  # ties go up
    if "classes" in parts:
        classes = profile.column_classes(df)
        e.categorical, e.numerical = (sum(c == k for c in classes.values()) for k in ("categorical", "numerical"))
        e.details["column_types"] = {k: sum(c == k for c in classes.values()) for k in dict.fromkeys(classes.values())}
    if "outliers" in parts:
        fences = profile.outliers(df, exact=exact).collect()
        e.outlier_pct = {r["column"]: r.outlier_pct for r in fences}
        e.details["outliers"] = {r["column"]: {"outliers": int(r.outliers), "outlier_pct": r.outlier_pct, "lower": r.lower, "upper": r.upper} for r in fences}
    if "correlations" in parts:
        found = [r for r in profile.correlations(df).collect() if r.r is not None]
        high = sorted((r for r in found if abs(r.r) > 0.8), key=lambda r: (-abs(r.r), r.column_a, r.column_b))
        e.high_pairs, e.max_abs_r = len(high), max((abs(r.r) for r in found), default=0.0)
        e.details["high_correlations"] = [r.asDict() for r in high]
    if "categories" in parts:
        texts = E.string_columns(df)
        if state:
            e.details["categorical_features"] = {c: {"n_unique": state[c].n_unique, "cardinality": "high" if state[c].n_unique > 50 else "medium" if state[c].n_unique > 10 else "low", "mode": state[c].top[0]["value"], "mode_count": state[c].top[0]["n"]} for c in texts if state[c].top}
        else:
            e.details["categorical_features"] = {r["column"]: {k: r[k] for k in ("n_unique", "cardinality", "mode", "mode_count")} for r in profile.categorical_features(df).collect()}
        e.high_cardinality = sum(c["cardinality"] == "high" for c in e.details["categorical_features"].values())
    if "numbers" in parts:
        if state:
            variances = {c: state[c]["std"] ** 2 if state[c]["std"] is not None else None for c in E.numeric_columns(df)}
            e.details["numeric_features"] = {c: {"variance": v, "low_variance": v is not None and v < 0.01, "n_unique": state[c].n_unique} for c, v in variances.items()}
        else:
            e.details["numeric_features"] = {r["column"]: {k: r[k] for k in ("variance", "low_variance", "n_unique")} for r in profile.numeric_features(df).collect()}
        e.low_variance = sum(r["low_variance"] for r in e.details["numeric_features"].values())
    e.binary = sum(r["n_unique"] == 2 for k in ("categorical_features", "numeric_features") for r in e.details.get(k, {}).values())
    if "consistency" in parts:
        _gather_consistency(e, df, compat)
    if target and "target" in parts:
        _gather_target(e, df, as_of, with_model, compat)
    return e


def _gather_consistency(e: scoring.Evidence, df: DataFrame, compat: bool) -> None:
    found = consistency.check(df, compat)
    e.consistency = found.score
    rules = {"mixed_types": found.mixed, "noise": found.noise, "categories": found.categorical, "units": found.units, "formats": found.formats}
    e.details["consistency"] = {"score": found.score, "columns": {k: sorted(v) for k, v in rules.items() if v}, "recommendations": found.recommendations()[:ADVICE]}


def _gather_target(e: scoring.Evidence, df: DataFrame, as_of: datetime, with_model: bool, compat: bool) -> None:
    target, problem = e.target, e.problem
    e.target_missing = df.where(profile.is_missing(df, target)).count()
    if problem == "classification":
        b = profile.class_balance(df, target).first()
        e.target_classes, e.balanced, e.imbalance = b.classes, b.balanced if b.balanced is not None else True, b.imbalance_ratio or 1.0
    elif target in E.numeric_columns(df):
        e.target_std = next((r["std"] for r in profile.target_statistics(df, target).collect()), None)
    leaks = leakage.check(df, target, as_of, compat=compat)
    e.leakage_risk = leaks.overall(compat)
    e.details["leakage"] = {"risk": e.leakage_risk, "columns": leaks.risks(compat), "recommendations": leaks.recommendations()[:ADVICE]}
    information = neighbours.neighbour_information if compat else importance.mutual_information
    e.max_mi = max((r.mi for r in information(df, target).collect()), default=0.0)
    if with_model:
        e.signal_points = baseline.train(df, target, problem).score(compat)


def analyze(
    df: DataFrame,
    target: str | None = None,
    problem_type: str = "auto",
    name: str = "table",
    size_mb: float = 0.0,
    as_of: datetime | None = None,
    assessor: assess.Assessor | None = None,
    key: str | None = None,
    with_model: bool = True,
    compat: bool = False,
    exact: bool = True,
    keep: bool = True,
) -> dict:
    """The report as a dict. ``key`` names a column that orders rows (one is added if None). ``exact``: see ``gather``. ``keep``: whether
    the table is persisted (in memory, then on disk) while it is read; without, every job scans it anew."""
    if problem_type not in ("auto", "classification", "regression"):
        raise ValueError("problem_type is auto, classification or regression")
    began = time.time()
    df = tables.normalize(tables.check(df))
    df = df.persist() if keep else df
    try:
        target = profile.detect_target(df, target or None)
        problem = profile.problem_type(df, target).first().problem_type if problem_type == "auto" else problem_type
        e = gather(df, target, problem, as_of or datetime.now(timezone.utc).replace(tzinfo=None), with_model, compat, exact)
        quality = scoring.quality(e)
        found = issues.detected(e)
        insight = assess.fallback(found) | {"red_flags": [], "pipeline": "", "action_items": [{"action": i["recommendation"], "impact": i["severity"].upper(), "effort": ""} for i in found[:5]]}
        if assessor is not None:
            keyed = df if key else tables.with_row_id(df)
            samples = telling.samples(keyed, key or "_row_id", compat=compat)
            answer = assess.read_answer(assessor(assess.request(quality, samples, sampling.summary(samples))))
            if "error" not in answer:
                checked = validation.validate(keyed, answer["blocking_issues"], key or "_row_id")
                if assess.NUMBER_KEY in answer:
                    weight = scoring.blend_weight(answer.get("confidence_level"), checked["confidence"])
                    quality["overall"] = scoring.blend(quality["overall"], answer[assess.NUMBER_KEY], weight)
                    quality["grade"] = scoring.grade(quality["overall"])
                insight = assess.insights(answer)
        shown = {k: e.details.get(k) for k in ("outliers", "high_correlations", "numeric_features", "categorical_features", "leakage", "consistency")}
        return {
            "analysis_id": str(uuid.uuid4()),
            "timestamp": datetime.now(timezone.utc),
            "dataset_info": {"filename": name, "rows": e.rows, "columns": e.columns, "size_mb": float(size_mb), "detected_problem_type": problem, "detected_target_column": target},
            "quality_score": quality,
            "data_profile": {
                "missing_pct": float(e.missing_pct),
                "duplicate_rows": e.details["duplicate_rows"],
                "duplicate_pct": e.duplicate_pct,
                "column_types": e.details["column_types"],
                "numeric_summary": {"columns": float(e.numerical), "low_variance": float(e.low_variance), "high_pairs": float(e.high_pairs), "mean_outlier_pct": round(sum(e.outlier_pct.values()) / max(1, len(e.outlier_pct)), 2)},
                "categorical_summary": {"columns": float(e.categorical), "high_cardinality": float(e.high_cardinality), "binary": float(e.binary)},
                "missing": e.missing_by_column,
                **shown,
            },
            "detected_issues": found,
            "model_recommendations": models.ranking(e, problem),
            "preprocessing_recommendations": issues.preprocessing(e),
            "insights": insight,
            "processing_seconds": round(time.time() - began, 2),
        }
    finally:
        if keep:
            df.unpersist()


def as_table(spark: SparkSession, report: dict) -> DataFrame:
    """The report as a table of one row, to be written with sources.tables.write_report."""
    return spark.createDataFrame([report], SCHEMA)


def analyze_file(spark: SparkSession, path: str, **options) -> dict:
    """The report of a file; of a workbook its first sheet."""
    df = workbook.read_workbook(spark, path) if path.lower().endswith(".xlsx") else tables.read_table(spark, path)
    return analyze(df, name=path.rstrip("/").rsplit("/", 1)[-1], size_mb=tables.size_mb(spark, path), **options)
