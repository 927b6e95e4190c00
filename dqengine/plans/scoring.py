"""Scores from evidence that the operators have gathered: pure functions over a few numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

from dqengine.functions import catalogs as C


@dataclass
class Evidence:
    """What the scores need to know of a table."""

    rows: int = 0
    columns: int = 0
    missing_pct: float = 0.0
    missing_by_column: dict[str, float] = field(default_factory=dict)
    duplicate_pct: float = 0.0
    outlier_pct: dict[str, float] = field(default_factory=dict)
    high_pairs: int = 0
    max_abs_r: float = 0.0
    high_cardinality: int = 0
    categorical: int = 0
    numerical: int = 0
    binary: int = 0
    low_variance: int = 0
    consistency: float = 100.0
    target: str | None = None
    problem: str | None = None
    target_missing: int = 0
    target_classes: int = 0
    target_std: float | None = None
    balanced: bool = True
    imbalance: float = 1.0
    leakage_risk: str | None = None
    max_mi: float | None = None
    signal_points: float = 30.0
    details: dict = field(default_factory=dict)
    """What the report shows of each column; no score reads it."""


def clamp(x: float) -> float:
    return float(max(0.0, min(100.0, x)))


def first_at_least(x: float, steps: list[tuple[float, float]], below: float) -> float:
    return next((v for least, v in steps if x >= least), below)


def first_above(x: float, steps: list[tuple[float, float]]) -> float:
    return next((v for bound, v in steps if x > bound), 0)


def grade(score: float) -> str:
    return next((g for least, g in C.GRADES if score >= least), "F")


def quantity(e: Evidence) -> float:
    """Rows per feature, less for small tables and unbalanced classes."""
    per = e.rows / max(1, e.columns - 1)
    score = first_at_least(per, [(100, 95), (50, 82), (20, 65), (10, 45)], 25)
    score -= 20 if e.rows < 100 else 10 if e.rows < 500 else 0
    if not e.balanced:
        score -= first_above(e.imbalance, [(20, 15), (10, 10), (5, 5)])
    score -= 15 if per < 10 else 8 if per < 20 else 0
    return clamp(score)


def completeness(e: Evidence) -> float:
    score = 100 - min(2 * e.missing_pct, 40) - 5 * sum(p > 40 for p in e.missing_by_column.values()) - min(1.5 * e.duplicate_pct, 20)
    return float(max(0.0, score - (50 if e.rows == 0 else 0)))


def consistency(e: Evidence) -> float:
    score = e.consistency - min(5 * sum(p > 15 for p in e.outlier_pct.values()), 20)
    return float(max(0.0, score - (min(e.high_pairs, 15) if e.high_pairs > 5 else 2 * e.high_pairs)))


def signal(e: Evidence) -> float:
    """With a target: the baseline model's points, less for constant and uninformative features; else from correlations."""
    if e.target is None:
        base = next((v for bound, v in [(0.8, 75), (0.6, 68), (0.3, 55)] if e.max_abs_r > bound), 40)
        return clamp(base - 5 * e.low_variance)
    weak = 0 if e.max_mi is None else 20 if e.max_mi < 0.05 else 10 if e.max_mi < 0.1 else 0
    return clamp(e.signal_points - min(3 * e.low_variance, 15) - weak)


def suitability(e: Evidence) -> float:
    if e.target is None:
        return 50.0
    score = 90.0 - min(3 * e.target_missing, 30)
    if e.problem == "classification":
        score -= first_above(e.imbalance, [(50, 25), (20, 20), (10, 15), (5, 8)])
        score -= 25 if e.target_classes > 0.5 * e.rows else 15 if e.target_classes > max(100, 0.1 * e.rows) else 0
    elif e.target_std == 0:
        score -= 30
    return clamp(score - {"high": 30, "medium": 15, "low": 5}.get(e.leakage_risk or "", 0))


def quality(e: Evidence) -> dict:
    """Overall score, grade and the five parts with grade and description."""
    parts = {
        "data_quantity": quantity(e),
        "data_completeness": completeness(e),
        "data_consistency_validity": consistency(e),
        "signal_to_noise_ratio": signal(e),
        "target_suitability": suitability(e),
    }
    overall = round(sum(C.SCORE_WEIGHTS[k] * v for k, v in parts.items()), 2)
    grades = {k: "C" if k == "target_suitability" and e.target is None else grade(v) for k, v in parts.items()}
    return {"overall": overall, "grade": grade(overall), "breakdown": {k: {"score": round(v, 2), "grade": grades[k], "description": describe(k, v)} for k, v in parts.items()}}


def describe(part: str, score: float) -> str:
    level = next((w for least, w in [(85, "strong"), (70, "good"), (50, "fair")] if score >= least), "poor")
    subject = {"data_quantity": "Amount of data", "data_completeness": "Completeness", "data_consistency_validity": "Consistency", "signal_to_noise_ratio": "Signal", "target_suitability": "Target"}
    return f"{subject[part]}: {level}"


# Blending with an outside assessment. Weight by stated confidence, change by how well its claims held.
CONFIDENCE_WEIGHT = {"HIGH": 0.35, "MEDIUM": 0.25, "LOW": 0.15}
UNSTATED_WEIGHT = 0.20
RELIABILITY_CHANGE = {"HIGH": 0.10, "LOW": -0.15}


def blend_weight(confidence: str | None, reliability: str | None) -> float:
    weight = CONFIDENCE_WEIGHT.get(confidence, UNSTATED_WEIGHT) + RELIABILITY_CHANGE.get(reliability, 0.0)
    return round(min(0.45, max(0.05, weight)), 3)


def blend(own: float, other: float, weight: float) -> float:
    """Moves by weight towards the other score, of which at most 15 points either way count."""
    return round(clamp(own + weight * max(-15.0, min(15.0, other - own))), 2)


def blend_reason(own: float, other: float) -> str:
    step = other - own
    size = "small" if abs(step) < 5 else "moderate" if abs(step) < 10 else "large"
    return f"{size} {'rise' if step >= 0 else 'fall'}" + (", capped" if abs(step) > 15 else "")


# Penalties that grow faster than the number of issues.


def issue_penalty(issue: dict) -> float:
    columns = min(1 + (len(issue.get("affected_columns", [])) - 1) * 0.2, 2.0)
    return C.IMPACT.get(issue.get("issue_type", ""), 0.5) * C.SEVERITY.get(issue.get("severity", "MEDIUM"), 0.6) * columns * 20


def combination_penalty(issues: list[dict]) -> float:
    types = {i.get("issue_type") for i in issues}
    return sum(p for pair, p in C.COMBINATIONS if types.issuperset(pair)) + (2.0 if len(issues) >= 3 else 0.0)


def coverage_penalty(issues: list[dict]) -> float:
    total = 0.0
    for i in issues:
        text, n = i.get("verification_details", "").lower(), len(i.get("affected_columns", []))
        total += next((p for words, p in [(("widespread", "most"), 3.0), (("many", "several"), 2.0), (("some",), 1.0)] if any(w in text for w in words)), 0.0)
        total += 2.0 if n > 3 else 1.0 if n > 1 else 0.0
    return min(total, 10.0)


def compounding_penalty(n: int, penalty: float) -> float:
    return min(0.15 * penalty * (1.2 ** (n - 3) - 1), 15.0) if n > 3 else 0.0


def non_linear(score: float, issues: list[dict]) -> dict:
    """The score after penalties for verified issues, with the penalties by kind; never under 10."""
    held = [i for i in issues if i.get("validation_status") == "VERIFIED"]
    parts = {"individual_issue": sum(map(issue_penalty, held)), "combination_penalty": combination_penalty(held), "coverage_penalty": coverage_penalty(held)}
    parts["scaling_penalty"] = compounding_penalty(len(held), sum(parts.values()))
    total = sum(parts.values())
    final = max(10.0, score - total)
    size = "severe" if total > 20 else "considerable" if total > 10 else "slight"
    return {"score": final, "grade": grade(final), "total_penalty": total, "penalties": parts, "issues": len(held), "explanation": f"{size} penalties from {len(held)} verified issues"}
