"""Ranking model families by rules on a table's fingerprint."""

from __future__ import annotations

from dataclasses import dataclass

from dqengine.functions import catalogs as C
from dqengine.plans.scoring import Evidence


@dataclass
class Fingerprint:
    size: str
    high_dimensional: bool
    missing: str
    correlated_pairs: int
    category_ratio: float
    imbalanced: bool
    severe: bool
    weak_signal: bool
    strong_signal: bool
    robust: bool
    interpretable: bool
    fast: bool
    heavy: bool


def fingerprint(e: Evidence) -> Fingerprint:
    mi = e.max_mi or 0.0
    noisy = [p for p in e.outlier_pct.values() if p > 10]
    return Fingerprint(
        size="tiny" if e.rows < 100 else "small" if e.rows < 1_000 else "medium" if e.rows < 10_000 else "large",
        high_dimensional=e.columns > 0.1 * e.rows,
        missing="none" if e.missing_pct == 0 else "low" if e.missing_pct < 5 else "moderate" if e.missing_pct < 20 else "high",
        correlated_pairs=e.high_pairs,
        category_ratio=e.categorical / max(1, e.columns),
        imbalanced=not e.balanced,
        severe=e.imbalance > 10,
        weak_signal=mi < 0.1,
        strong_signal=mi > 0.5,
        robust=len(noisy) > 2 or e.missing_pct > 10,
        interpretable=e.rows / max(1, e.columns) < 20 or mi < 0.2,
        fast=e.rows > 50_000,
        heavy=e.categorical > 5 or e.missing_pct > 15,
    )


def family(name: str) -> str:
    for part, found in (("XGBoost", "boost"), ("LightGBM", "boost"), ("Random Forest", "forest"), ("Linear", "linear"), ("Logistic", "linear"), ("SVM", "svm")):
        if part in name:
            return found
    return "elastic"


@dataclass
class Case:
    """A model and a table: what rules ask."""

    name: str
    kind: str
    missing_ok: bool
    categories_ok: bool
    readable: bool
    f: Fingerprint
    classify: bool

    @property
    def small(self) -> bool:
        return self.f.size in ("tiny", "small")


# Points by rule. Of each rule's lines the first whose families and condition fit counts; None stands for any family.
ANY = None
RULES = {
    "size": [
        ("boost", lambda c: c.f.size == "tiny", -15),
        ("boost", lambda c: c.f.size == "small", 10),
        ("boost", lambda c: True, 20),
        ("forest", lambda c: c.f.size == "tiny", 5),
        ("forest", lambda c: True, 15),
        ("linear svm", lambda c: c.small, 15),
        ("linear svm", lambda c: c.f.high_dimensional, 20),
        ("linear", lambda c: True, 5),
        ("svm", lambda c: True, -10),
        ("elastic", lambda c: c.f.high_dimensional or c.f.correlated_pairs > 5, 25),
        ("elastic", lambda c: c.f.size in ("small", "medium"), 10),
        ("elastic", lambda c: True, 5),
    ],
    "missing": [(ANY, lambda c: c.f.missing == "none", 0), (ANY, lambda c: c.missing_ok, 15), (ANY, lambda c: True, -15)],
    "categories": [
        (ANY, lambda c: c.f.category_ratio == 0, 0),
        (ANY, lambda c: not c.categories_ok, lambda c: -(10 + int(10 * c.f.category_ratio))),
        ("boost", lambda c: c.f.category_ratio > 0.5, 20),
        (ANY, lambda c: True, 10),
    ],
    "balance": [(ANY, lambda c: c.classify and c.f.imbalanced and c.f.severe, 15), (ANY, lambda c: c.classify and c.f.imbalanced, 10)],
    "robust": [("boost forest", lambda c: c.f.robust and "LightGBM" not in c.name, 15), ("linear", lambda c: c.f.robust, -10)],
    "readable": [(ANY, lambda c: c.f.interpretable and c.readable, 20), (ANY, lambda c: c.f.interpretable, -10)],
    "dimensions": [("elastic svm", lambda c: c.f.high_dimensional, 25), ("linear", lambda c: c.f.high_dimensional, 15), (ANY, lambda c: c.f.high_dimensional, -5)],
    "signal": [
        ("linear", lambda c: c.f.weak_signal and c.readable, 15),
        ("linear", lambda c: c.f.weak_signal, 5),
        (ANY, lambda c: c.f.weak_signal and c.readable, 10),
        ("boost forest", lambda c: c.f.strong_signal and not c.f.weak_signal and "LightGBM" not in c.name, 15),
    ],
    "speed": [
        ("boost", lambda c: c.f.fast and "LightGBM" in c.name, 20),
        ("linear", lambda c: c.f.fast, 15),
        ("forest", lambda c: c.f.fast, -5),
        ("svm", lambda c: c.f.fast, -15),
    ],
    "preparation": [(ANY, lambda c: c.f.heavy and c.missing_ok and c.categories_ok, 15)],
}


def score(model: tuple[str, bool, bool, bool], f: Fingerprint, problem: str) -> float:
    """50 and the points of all rules, held within 0 and 100."""
    case = Case(model[0], family(model[0]), *model[1:], f, problem == "classification")
    total = 50.0
    for lines in RULES.values():
        points = next((p for kinds, holds, p in lines if (kinds is ANY or case.kind in kinds.split()) and holds(case)), 0)
        total += points(case) if callable(points) else points
    return max(0.0, min(100.0, total))


def reasoning(model: tuple[str, bool, bool, bool], f: Fingerprint) -> str:
    name, missing_ok, categories_ok, interpretable = model
    said = [
        (f.missing != "none" and missing_ok, "takes missing values as they are"),
        (f.category_ratio > 0 and categories_ok, "takes categories well"),
        (f.interpretable and interpretable, "can be read and explained"),
        (f.high_dimensional and family(name) in ("elastic", "svm", "linear"), "stands many columns"),
        (f.robust and family(name) in ("boost", "forest"), "stands outliers"),
        (f.fast and "LightGBM" in name, "fast on many rows"),
    ]
    return " | ".join([text for on, text in said if on][:4]) or f"fits a {f.size} table"


def ranking(e: Evidence, problem: str, top: int = 3) -> list[dict]:
    f = fingerprint(e)
    models = C.CLASSIFIERS if problem == "classification" else C.REGRESSORS
    ranked = sorted(models, key=lambda m: -score(m, f, problem))[:top]
    return [{"rank": i, "model_name": m[0], "confidence_score": score(m, f, problem), "reasoning": reasoning(m, f)} for i, m in enumerate(ranked, 1)]
