"""Queries of the plans: evidence gathered from tables, what the scores, notes and rankings make of it, and the same in SQL over
the tables. Every query gathers the parts of the evidence that it reads, from the whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine import queries as Q
from dqengine.functions import catalogs as C
from dqengine.operators import consistency, leakage, profile, sampling, validation
from dqengine.plans import assess, issues, models, report, scoring

AS_OF = datetime(1998, 1, 1)


@dataclass(frozen=True)
class Table:
    """The columns of a table or projection by kind."""

    numbers: tuple[str, ...]
    texts: tuple[str, ...] = ()
    others: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.numbers, *self.texts, *self.others)


TABLES = {
    "dirty_lineitem": Table(("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus")),
    "noted_events": Table(("event_id", "value", "reading", "user_id"), ("event_type",)),
    "customer": Table(("c_custkey", "c_nationkey", "c_acctbal"), ("c_name", "c_mktsegment")),
    "dup_orders": Table(("o_custkey",), ("o_orderstatus", "o_orderpriority")),
    "leaky_lineitem": Table(("l_quantity", "l_extendedprice", "l_discount", "twin", "fixed", "close")),
    "nation": Table(("n_nationkey", "n_regionkey"), ("n_name",)),
}
TEXTS = Table(("o_orderkey",), ("o_orderstatus", "priority", "amount", "day_text", "phone", "sex"))


NOTES = frozenset({"missing", "classes"})
ISSUE_PARTS = frozenset({"missing", "duplicates", "correlations", "categories", "numbers"})
SCORE_PARTS = ISSUE_PARTS | {"outliers", "consistency"}
MODEL_PARTS = NOTES | {"correlations", "outliers"}


def evidence(spark: SparkSession, sf_dir: str, name: str, parts: frozenset[str]) -> scoring.Evidence:
    """Parts of a table's evidence; the table is kept while they are gathered."""
    df = Q.load(spark, sf_dir, name).persist()
    try:
        return report.gather(df, None, None, AS_OF, with_model=False, parts=parts)
    finally:
        df.unpersist()


# Consistency in SQL for any table: the twins of the single rules, over other values.


def _rule(query: str, values: str) -> str:
    return Q.REGISTRY[f"{query}_dirty_orders"][1].replace(Q._VALUES, values)


def consistency_sql(name: str, texts: tuple[str, ...]) -> str:
    """One number: the consistency score."""
    if not texts:
        return "SELECT 100.0 AS score"
    values = f"({Q.counted(name, list(texts))})"
    lost = lambda rule, high, other: f"(SELECT coalesce(sum(CASE WHEN severity = 'high' THEN {high} ELSE {other} END), 0) FROM ({_rule(rule, values)}))"
    named = lambda *rules: "(SELECT count(DISTINCT \"column\") FROM (" + " UNION ALL ".join(f'SELECT "column" FROM ({_rule(r, values)})' for r in rules) + "))"
    return (
        f"SELECT greatest(0, 100 - {lost('mixed_types', 20, 10)} - {lost('noise', 15, 8)} - 8 * {named('abbreviation_pairs', 'spelling_variants')} "
        f"- 5 * {named('unit_inconsistencies')} - 3 * {named('format_inconsistencies')})::DOUBLE AS score"
    )


def evidence_sql(name: str) -> str:
    """One row with all that scores and notes read."""
    t, src = TABLES[name], Q.source(name)
    pct = {c: f"coalesce(round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2), 0.0)" for c in t.columns}
    pairs = Q._pairs_sql(name, list(t.numbers)) if len(t.numbers) > 1 else "SELECT '' AS column_a, '' AS column_b, CAST(NULL AS DOUBLE) AS r"
    return f"""
SELECT a.*, d.dup, o.out15, o.out10, p.pairs, p.max_r, c.consistency FROM (
  SELECT count(*)::DOUBLE AS n, {len(t.columns)} AS k, {len(t.numbers)} AS numbers, {len(t.texts)} AS texts,
    round(({' + '.join(pct.values())}) / {len(t.columns)} + 1e-9, 2) AS miss, {' + '.join(f'({x} > 40)::INTEGER' for x in pct.values())} AS miss40,
    {' + '.join(f'(count(DISTINCT {c}) > 50)::INTEGER' for c in t.texts) or 0} AS high_card,
    {' + '.join(f'coalesce(var_samp({c}) < 0.01, false)::INTEGER' for c in t.numbers)} AS low_var FROM {src}) a,
  (SELECT coalesce(round((sum(m) - count(*)) * 100.0 / sum(m), 2), 0.0) AS dup FROM (SELECT count(*) AS m FROM (SELECT {', '.join(t.columns)} FROM {src}) GROUP BY {', '.join(t.columns)})) d,
  (SELECT count(*) FILTER (outlier_pct > 15) AS out15, count(*) FILTER (outlier_pct > 10) AS out10 FROM ({Q._outlier_sql(name, list(t.numbers))})) o,
  (SELECT count(*) FILTER (abs(r) > 0.8) AS pairs, coalesce(max(abs(r)), 0.0) AS max_r FROM ({pairs})) p,
  (SELECT score AS consistency FROM ({consistency_sql(name, t.texts)})) c"""


STEPS = lambda x, *steps, other=0: "CASE " + " ".join(f"WHEN {x} {op} {at} THEN {v}" for op, at, v in steps) + f" ELSE {other} END"
GRADE = lambda x: STEPS(x, (">=", 90, "'A'"), (">=", 80, "'B'"), (">=", 70, "'C'"), (">=", 60, "'D'"), other="'F'")
LEVEL = lambda x: STEPS(x, (">=", 85, "'strong'"), (">=", 70, "'good'"), (">=", 50, "'fair'"), other="'poor'")
_PER = "n / greatest(1, k - 1)"
PARTS = {
    "data_quantity": ("Amount of data", f"least(100, greatest(0, {STEPS(_PER, ('>=', 100, 95), ('>=', 50, 82), ('>=', 20, 65), ('>=', 10, 45), other=25)} - {STEPS('n', ('<', 100, 20), ('<', 500, 10))} - {STEPS(_PER, ('<', 10, 15), ('<', 20, 8))}))"),
    "data_completeness": ("Completeness", "greatest(0, 100 - least(2 * miss, 40) - 5 * miss40 - least(1.5 * dup, 20) - CASE WHEN n = 0 THEN 50 ELSE 0 END)"),
    "data_consistency_validity": ("Consistency", "greatest(0, greatest(0, consistency - least(5 * out15, 20)) - CASE WHEN pairs > 5 THEN least(pairs, 15) ELSE 2 * pairs END)"),
    "signal_to_noise_ratio": ("Signal", f"least(100, greatest(0, {STEPS('max_r', ('>', 0.8, 75), ('>', 0.6, 68), ('>', 0.3, 55), other=40)} - 5 * low_var))"),
    "target_suitability": ("Target", "50"),
}


def _score_rows(s: SparkSession, quality: dict) -> DataFrame:
    rows = [(k, v["score"], v["grade"], v["description"]) for k, v in quality["breakdown"].items()] + [("overall", quality["overall"], quality["grade"], "")]
    return s.createDataFrame([(p, float(x), g, t) for p, x, g, t in rows], "part string, score double, grade string, description string")


def _scores_sql(base: str, parts: dict[str, tuple[str, str]], fixed_grade: dict[str, str]) -> str:
    rows = [
        f"SELECT '{k}' AS part, round(({x})::DOUBLE, 2) AS score, {fixed_grade.get(k) or GRADE(f'({x})')} AS grade, concat('{said}: ', {LEVEL(f'({x})')}) AS description FROM e" for k, (said, x) in parts.items()
    ]
    whole = "round(" + " + ".join(f"{C.SCORE_WEIGHTS[k]} * ({x})::DOUBLE" for k, (_, x) in parts.items()) + ", 2)"
    return f"WITH e AS ({base}) " + " UNION ALL ".join(rows) + f" UNION ALL SELECT 'overall', {whole}, {GRADE(whole)}, '' FROM e"


def _listed(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _flags_sql(base: str, rows: list[tuple[str, ...]], names: tuple[str, ...], numbered: str | None = None, first: int | None = None) -> str:
    """Rows whose condition, the last of each, holds; in order, numbered from 1 if a name for that is given."""
    cells = " UNION ALL ".join(f"SELECT {i} AS _i, " + ", ".join(f"{v} AS {n}" for v, n in zip(r[:-1], names)) + f" FROM e WHERE {r[-1]}" for i, r in enumerate(rows))
    number = f"CAST(row_number() OVER (ORDER BY _i) AS INTEGER) AS {numbered}, " if numbered else ""
    return f"WITH e AS ({base}) SELECT {number}{', '.join(names)} FROM (SELECT * FROM ({cells}) ORDER BY _i{f' LIMIT {first}' if first else ''})"


ISSUES = [
    ("'missing_data'", "CASE WHEN miss > 20 THEN 'high' ELSE 'medium' END", "miss > 5"),
    ("'duplicates'", "CASE WHEN dup > 10 THEN 'medium' ELSE 'low' END", "dup > 5"),
    ("'correlation'", "'medium'", "pairs > 0"),
    ("'high_cardinality'", "'low'", "high_card > 0"),
    ("'low_variance'", "'low'", "low_var > 0"),
]
PREPROCESSING = [("'imputation'", "miss > 0"), ("'encoding'", "texts > 0"), ("'scaling'", "numbers > 0"), ("'deduplication'", "dup > 5")]
READINESS = [
    ("'too few rows'", "n < 100"), ("'few rows for so many columns'", "n / k < 10"), ("'far too many missing values'", "miss > 30"),
    ("'many missing values'", "miss > 15 AND miss <= 30"), ("'no target'", "true"), ("'categories need encoding'", "texts > 0"),
]
SUGGESTED = [("'impute missing values'", "miss > 0"), ("'encode categories'", "texts > 0"), ("'scale numbers'", "numbers > 1"), ("'drop duplicates'", "dup > 0")]
RISKS = [("CASE WHEN n / k < 10 THEN 'high' ELSE 'medium' END", "'overfitting'", "n / k < 20"), ("'medium'", "'bias from missing values'", "miss > 20"), ("'high'", "'more columns than rows'", "k > n")]
_POINTS = f"({STEPS('miss', ('>', 20, 3), ('>', 5, 2), ('>', 0, 1))} + {STEPS('texts', ('>', 5, 2), ('>', 0, 1))} + high_card)"
SUMMARY_SQL = (
    f"SELECT {STEPS('n', ('<', 100, chr(39) + 'very_small' + chr(39)), ('<', 1000, chr(39) + 'small' + chr(39)), ('<', 10000, chr(39) + 'medium' + chr(39)), ('<', 100000, chr(39) + 'large' + chr(39)), other=chr(39) + 'very_large' + chr(39))} AS size_category, "
    f"round(n / greatest(1, k), 4) AS samples_per_feature, CASE WHEN {_POINTS} >= 6 THEN 'high' WHEN {_POINTS} >= 3 THEN 'medium' ELSE 'low' END AS complexity"
)
FINGERPRINT_SQL = (
    "SELECT CASE WHEN n < 100 THEN 'tiny' WHEN n < 1000 THEN 'small' WHEN n < 10000 THEN 'medium' ELSE 'large' END AS size, k > 0.1 * n AS high_dimensional, "
    "CASE WHEN miss = 0 THEN 'none' WHEN miss < 5 THEN 'low' WHEN miss < 20 THEN 'moderate' ELSE 'high' END AS missing, pairs::INTEGER AS correlated_pairs, round(texts / greatest(1, k), 4) AS category_ratio, "
    "false AS imbalanced, false AS severe, true AS weak_signal, false AS strong_signal, out10 > 2 OR miss > 10 AS robust, true AS interpretable, n > 50000 AS fast, texts > 5 OR miss > 15 AS heavy"
)
_ALL_MODELS = " UNION ALL ".join(
    f"SELECT '{problem}' AS problem, '{name}' AS model, '{models.family(name)}' AS kind, {str(a).lower()} AS missing_ok, {str(b).lower()} AS categories_ok, {str(c).lower()} AS readable"
    for problem, many in (("classification", C.CLASSIFIERS), ("regression", C.REGRESSORS))
    for name, a, b, c in many
)
MODEL_SCORES_SQL = f"""
SELECT problem, model, least(100, greatest(0, 50
  + CASE kind WHEN 'boost' THEN CASE size WHEN 'tiny' THEN -15 WHEN 'small' THEN 10 ELSE 20 END
              WHEN 'forest' THEN CASE size WHEN 'tiny' THEN 5 ELSE 15 END
              WHEN 'linear' THEN CASE WHEN size IN ('tiny', 'small') THEN 15 WHEN high_dimensional THEN 20 ELSE 5 END
              WHEN 'svm' THEN CASE WHEN size IN ('tiny', 'small') THEN 15 WHEN high_dimensional THEN 20 ELSE -10 END
              ELSE CASE WHEN high_dimensional OR correlated_pairs > 5 THEN 25 WHEN size IN ('small', 'medium') THEN 10 ELSE 5 END END
  + CASE WHEN missing = 'none' THEN 0 WHEN missing_ok THEN 15 ELSE -15 END
  + CASE WHEN ratio = 0 THEN 0 WHEN NOT categories_ok THEN -(10 + floor(10 * ratio)) WHEN kind = 'boost' AND ratio > 0.5 THEN 20 ELSE 10 END
  + CASE WHEN NOT robust THEN 0 WHEN contains(model, 'XGBoost') OR kind = 'forest' THEN 15 WHEN kind = 'linear' THEN -10 ELSE 0 END
  + CASE WHEN NOT interpretable THEN 0 WHEN readable THEN 20 ELSE -10 END
  + CASE WHEN NOT high_dimensional THEN 0 WHEN kind IN ('elastic', 'svm') THEN 25 WHEN kind = 'linear' THEN 15 ELSE -5 END
  + CASE WHEN weak_signal THEN CASE WHEN readable THEN 10 ELSE 0 END + CASE WHEN kind = 'linear' THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN NOT fast THEN 0 WHEN contains(model, 'LightGBM') THEN 20 WHEN kind = 'linear' THEN 15 WHEN kind = 'forest' THEN -5 WHEN kind = 'svm' THEN -15 ELSE 0 END
  + CASE WHEN heavy AND missing_ok AND categories_ok THEN 15 ELSE 0 END))::DOUBLE AS score
FROM (SELECT *, texts / greatest(1, k) AS ratio FROM f, e), m"""


def _model_scores(s: SparkSession, e: scoring.Evidence) -> DataFrame:
    f = models.fingerprint(e)
    return _listed(s, [(p, m[0], models.score(m, f, p)) for p, many in (("classification", C.CLASSIFIERS), ("regression", C.REGRESSORS)) for m in many], "problem string, model string, score double")


def _with_target_sql(name: str, target: str, features: list[str]) -> str:
    """The evidence of a table with a class to predict: leakage, information and balance besides."""
    names = ", ".join(f"('{c}')" for c in features)
    hits = Q.REGISTRY["leak_names_lineitem"][1].replace("(DESCRIBE lineitem)", f"(VALUES {names}) AS v(column_name)")
    predictors = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(sum(n) FILTER (v IS NOT NULL AND k = 1), 0) / sum(n) AS ratio FROM (SELECT {c} AS v, count(DISTINCT {target}) AS k, count(*) AS n FROM {Q.source(name)} GROUP BY 1)" for c in features
    )
    return f"""
SELECT e.*, b.*, m.max_mi, l.risk FROM ({evidence_sql(name)}) e,
  (SELECT count(*) AS classes, max(c)::DOUBLE / min(c) AS imbalance, max(c) < 0.6 * sum(c) AS balanced FROM (SELECT count(*) AS c FROM {Q.source(name)} WHERE {target} IS NOT NULL GROUP BY {target})) b,
  (SELECT max(mi) AS max_mi FROM ({Q._information_sql(name, target, features)})) m,
  (SELECT max(risk) AS risk FROM (SELECT CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS risk FROM ({hits}) UNION ALL SELECT CASE WHEN ratio >= 0.5 THEN 2 ELSE 1 END FROM ({predictors}) WHERE ratio >= 0.2 UNION ALL SELECT 0)) l"""


TABLES["flagged_lineitem"] = Table(("l_linenumber",), ("l_returnflag", "hint", "l_linestatus"))
_CHANGE = f"CASE WHEN balanced THEN 0 ELSE {STEPS('imbalance', ('>', 20, 15), ('>', 10, 10), ('>', 5, 5))} END"
TARGET_PARTS = PARTS | {
    "data_quantity": ("Amount of data", PARTS["data_quantity"][1].replace(" - CASE", f" - {_CHANGE} - CASE", 1)),
    "signal_to_noise_ratio": ("Signal", f"least(100, greatest(0, 30 - least(3 * low_var, 15) - {STEPS('max_mi', ('<', 0.05, 20), ('<', 0.1, 10))}))"),
    "target_suitability": (
        "Target",
        f"least(100, greatest(0, 90 - {STEPS('imbalance', ('>', 50, 25), ('>', 20, 20), ('>', 10, 15), ('>', 5, 8))} - CASE WHEN classes > 0.5 * n THEN 25 WHEN classes > greatest(100, 0.1 * n) THEN 15 ELSE 0 END - CASE risk WHEN 2 THEN 30 WHEN 1 THEN 15 ELSE 5 END))",
    ),
}


def _target_evidence(s: SparkSession, d: str) -> scoring.Evidence:
    return report.gather(Q.load(s, d, "flagged_lineitem"), "l_returnflag", "classification", AS_OF, with_model=False)


def _leak_risks(s: SparkSession, d: str) -> DataFrame:
    found = leakage.check(Q.load(s, d, "telling_lineitem"), "l_returnflag", AS_OF)
    return _listed(s, [(c, r, found.overall()) for c, r in found.risks().items()], "column string, risk string, overall string")


def _leak_risks_sql() -> str:
    predictors = Q.REGISTRY["predictor_leaks_telling_lineitem"][1]
    rows = f"SELECT \"column\", risk FROM ({predictors}) UNION ALL SELECT 'order_id', 'medium' UNION ALL SELECT 'ship_date', 'medium'"
    rank = "CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
    word = "CASE max(max({r})) OVER () WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END".replace("{r}", rank)
    return f"SELECT \"column\", CASE max({rank}) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, {word} AS overall FROM ({rows}) GROUP BY \"column\""


def _claims_sql() -> str:
    """The status of each claim from the table itself."""
    normal = "lower(trim({c}))"
    nulls = lambda c: f"EXISTS (SELECT 1 FROM {Q.source('dirty_orders')} WHERE {normal.format(c=c)} IN ({Q.quoted(C.CLAIM_NULL_TOKENS)}))"
    shares = Q.REGISTRY["mixed_shares_dirty_orders_whole"][1]
    mixed = f"(SELECT numeric > 0.05 AND greatest(number_words, other) > 0.05 FROM ({shares}))"
    varied = lambda q, least: f"(SELECT coalesce(sum(n) > 10 AND count(*) FILTER (share > {least}) > 1, false) FROM (SELECT n, n / sum(n) OVER () AS share FROM ({q})))"
    kinds = lambda c: [Q.REGISTRY[f"{q}_dirty_orders_whole"][1].replace(old, c) for q, old in (("date_kinds", "day_text"), ("number_kinds", "amount"))]

    def formats(c: str) -> str:
        # The projection's own expression for the column is left as it is; only what is read from it changes.
        day, number = (f"(SELECT trim(CAST({c} AS VARCHAR)) AS value FROM {Q.source('dirty_orders')} WHERE {c} IS NOT NULL)" for _ in range(2))
        dates = f"SELECT * FROM (SELECT CASE WHEN contains(value, '/') THEN 'slash' WHEN contains(value, '-') THEN 'dash' WHEN contains(value, '.') THEN 'dot' END AS kind, count(*) AS n FROM {day} WHERE length(value) > 5 AND regexp_matches(value, '\\d') GROUP BY 1) WHERE kind IS NOT NULL"
        numbers = f"SELECT * FROM (SELECT CASE WHEN regexp_matches(value, '[$€£¥]') THEN 'currency' WHEN regexp_matches(value, '^\\d+\\.?\\d*$') THEN 'plain' WHEN regexp_matches(value, '\\d+[eE][+-]?\\d+') THEN 'scientific' WHEN contains(value, '%') AND regexp_matches(value, '\\d') THEN 'percentage' END AS kind, count(*) AS n FROM {number} GROUP BY 1) WHERE kind IS NOT NULL"
        return f"CASE WHEN {varied(dates, 0.05)} OR {varied(numbers, 0.1)} THEN 'VERIFIED' ELSE 'PARTIAL' END"

    yes = lambda c: f"CASE WHEN {c} THEN 'VERIFIED' ELSE 'UNVERIFIED' END"
    repeated = f"(SELECT count(*) < (SELECT count(*) FROM orders) FROM (SELECT DISTINCT * FROM {Q.source('dirty_orders')}))"
    numeric_pairs = len(list(combinations(TEXTS.numbers, 2)))
    status = [yes(mixed), yes(nulls("priority")), yes(nulls("sex")), formats("day_text"), formats("sex"), yes("true"), yes("true"), yes(repeated), yes(f"{numeric_pairs} > 0"), "'UNVERIFIED'"]
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS claim, '{c['issue_type']}' AS issue_type, {x} AS validation_status" for i, (c, x) in enumerate(zip(Q.CLAIMS, status)))


def _confidence(s: SparkSession, d: str) -> DataFrame:
    found = validation.validate(Q.load(s, d, "dirty_orders"), Q.CLAIMS, "o_orderkey")
    return _listed(s, [(round(found["verified_rate"], 4), round(found["partial_rate"], 4), found["confidence"])], "verified double, partial double, confidence string")


TARGETS = {
    "flagged_lineitem": ("l_returnflag", ["l_linenumber", "hint", "l_linestatus"]),
    "rare_lineitem": ("kind", ["l_linenumber", "l_linestatus", "l_returnflag"]),
    "sure_lineitem": ("l_returnflag", ["l_linenumber", "l_linestatus", "sure"]),
}
"""Tables with a class to predict: severe imbalance in one, a feature that tells the class in another."""
TABLES["rare_lineitem"] = Table(("l_linenumber",), ("l_linestatus", "l_returnflag", "kind"))
TABLES["sure_lineitem"] = Table(("l_linenumber",), ("l_linestatus", "sure", "l_returnflag"))
TABLES["orders"] = Table(("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority"), ("o_orderdate",))
TARGET_FINGERPRINT_SQL = (
    FINGERPRINT_SQL.replace("false AS imbalanced, false AS severe, true AS weak_signal, false AS strong_signal", "NOT balanced AS imbalanced, imbalance > 10 AS severe, max_mi < 0.1 AS weak_signal, max_mi > 0.5 AS strong_signal")
    .replace("true AS interpretable", "n / greatest(1, k) < 20 OR max_mi < 0.2 AS interpretable")
)
TARGET_MODEL_SCORES_SQL = MODEL_SCORES_SQL.replace(
    "  + CASE WHEN NOT robust",
    "  + CASE WHEN problem = 'classification' AND imbalanced THEN CASE WHEN severe THEN 15 ELSE 10 END ELSE 0 END\n"
    "  + CASE WHEN strong_signal AND kind IN ('boost', 'forest') AND NOT contains(model, 'LightGBM') THEN 15 ELSE 0 END\n  + CASE WHEN NOT robust",
)


def _target_models(s: SparkSession, d: str, name: str, target: str) -> scoring.Evidence:
    df = Q.load(s, d, name).persist()
    try:
        return report.gather(df, target, "classification", AS_OF, with_model=False, parts=MODEL_PARTS | {"target"})
    finally:
        df.unpersist()


def _ranked(s: SparkSession, e: scoring.Evidence) -> DataFrame:
    return _listed(s, [(m["rank"], m["model_name"], m["confidence_score"]) for m in models.ranking(e, "classification")], "rank int, model string, score double")


def _ranking_sql() -> str:
    """The three best models, ties in order of the catalog. Numbers are cut into twentieths for the information they give."""
    cut = "(SELECT " + ", ".join([*(f"ntile(20) OVER (ORDER BY {c}) AS {c}" for c in TABLES["orders"].numbers), "o_orderstatus", "o_orderpriority", "o_orderdate"]) + " FROM orders)"
    base = _with_target_sql("orders", "o_orderstatus", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    information = Q._information_sql("orders", "o_orderstatus", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    base = base.replace(information, information.replace("FROM orders", f"FROM {cut} AS orders"))
    place = "CASE model " + " ".join(f"WHEN '{m[0]}' THEN {i}" for i, m in enumerate(C.CLASSIFIERS)) + " END"
    scores = f"WITH e AS ({base}), f AS ({TARGET_FINGERPRINT_SQL} FROM e), m AS ({_ALL_MODELS}) {TARGET_MODEL_SCORES_SQL}"
    return f"SELECT CAST(row_number() OVER (ORDER BY score DESC, {place}) AS INTEGER) AS rank, model, score FROM ({scores}) WHERE problem = 'classification' QUALIFY rank <= 3"


DETECT = {
    "labels": Table(("doc_id", "quality", "toxic")),
    "flags_labels": Table(("quality", "toxic", "doc_id", "nothing"), ("answer",), ("flag",)),
    "orders": Table(("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority"), ("o_orderdate",)),
    "noted_events": TABLES["noted_events"],
    "nation": TABLES["nation"],
}


def _detected_sql(name: str, order: list[str]) -> str:
    t, rows = DETECT[name], []
    for i, c in enumerate(order):
        allowed = f"lower({c}) IN ('yes', 'no')" if c in t.texts else f"{c} IN (0, 1)" if c in t.numbers else f"CAST({c} AS VARCHAR) IN ('true', 'false')"
        flag = "true" if c == "flag" else "false"
        rows.append(f"SELECT '{c}' AS c, {i} AS i, CASE WHEN '{c}' IN ({Q.quoted(C.TARGET_NAMES)}) THEN 10 WHEN {flag} THEN 8 WHEN count(*) FILTER ({c} IS NOT NULL AND NOT {allowed}) = 0 THEN 7 WHEN {i} = {len(order) - 1} THEN 5 ELSE 0 END AS r FROM {Q.source(name)}")
    return f"SELECT '{name}' AS \"table\", arg_min(c, struct_pack(r := -r, i := i)) AS target FROM ({' UNION ALL '.join(rows)})"


ORDER = {
    "labels": ["doc_id", "quality", "toxic"], "flags_labels": ["quality", "toxic", "answer", "doc_id", "flag", "nothing"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "noted_events": ["event_id", "event_type", "value", "reading", "user_id"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


def _detected(s: SparkSession, d: str) -> DataFrame:
    return _listed(s, [(t, profile.detect_target(Q.load(s, d, t))) for t in DETECT], "table string, target string")


def _numeric(c: str) -> str:
    return Q.IS_NUMERIC.replace("value", c)


def _table_summary(s: SparkSession, e: scoring.Evidence) -> DataFrame:
    return _listed(s, [(issues.size_category(e.rows), round(issues.samples_per_feature(e), 4), issues.complexity(e))], "size_category string, samples_per_feature double, complexity string")


def register_all(register: Callable) -> None:
    for name, t in TABLES.items():
        if name in ("orders", "rare_lineitem", "sure_lineitem"):
            continue
        base = evidence_sql(name)
        e = functools.partial(lambda s, d, parts, name: evidence(s, d, name, parts), name=name)
        register(f"scores_{name}", lambda s, d, e=e: _score_rows(s, scoring.quality(e(s, d, SCORE_PARTS))), _scores_sql(base, PARTS, {"target_suitability": "'C'"}))
        register(f"issues_{name}", lambda s, d, e=e: _listed(s, [(i["category"], i["severity"]) for i in issues.detected(e(s, d, ISSUE_PARTS))], "category string, severity string"), _flags_sql(base, ISSUES, ("category", "severity")))
        register(f"preprocessing_{name}", lambda s, d, e=e: _listed(s, [(i["priority"], i["category"]) for i in issues.preprocessing(e(s, d, NOTES | {"duplicates"}))], "priority int, category string"), _flags_sql(base, PREPROCESSING, ("category",), "priority"))
        register(f"readiness_{name}", lambda s, d, e=e: _listed(s, [(n,) for n in issues.readiness(e(s, d, NOTES))], "note string"), _flags_sql(base, READINESS, ("note",)))
        register(f"suggested_steps_{name}", lambda s, d, e=e: _listed(s, [(n,) for n in issues.suggested_steps(e(s, d, NOTES | {"duplicates"}))], "step string"), _flags_sql(base, SUGGESTED, ("step",), first=5))
        register(f"risk_factors_{name}", lambda s, d, e=e: _listed(s, issues.risk_factors(e(s, d, frozenset({"missing"}))), "level string, risk string"), _flags_sql(base, RISKS, ("level", "risk")))
        register(
            f"table_summary_{name}",
            lambda s, d, e=e: _table_summary(s, e(s, d, NOTES | {"categories"})),
            f"WITH e AS ({base}) {SUMMARY_SQL} FROM e",
        )
        register(f"model_fingerprint_{name}", lambda s, d, e=e: s.createDataFrame([models.fingerprint(e(s, d, MODEL_PARTS))]).withColumn("correlated_pairs", F.col("correlated_pairs").cast("int")).withColumn("category_ratio", F.round("category_ratio", 4)), f"WITH e AS ({base}) {FINGERPRINT_SQL} FROM e")
        register(f"model_scores_{name}", lambda s, d, e=e: _model_scores(s, e(s, d, MODEL_PARTS)), f"WITH e AS ({base}), f AS ({FINGERPRINT_SQL} FROM e), m AS ({_ALL_MODELS}) {MODEL_SCORES_SQL}")
        counts = ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ("high", "medium", "low"))
        register(f"issue_counts_{name}", lambda s, d, e=e: _listed(s, [tuple(issues.severity_counts(issues.detected(e(s, d, ISSUE_PARTS))).values())], "high long, medium long, low long"), f"SELECT {counts} FROM ({_flags_sql(base, ISSUES, ('category', 'severity'))})")
        register(
            f"issue_summary_{name}",
            lambda s, d, e=e: _listed(s, [(assess.fallback(issues.detected(e(s, d, ISSUE_PARTS)))["summary"],)], "summary string"),
            f"SELECT concat(high, ' high, ', medium, ' medium and ', low, ' low issues') AS summary FROM (SELECT {counts} FROM ({_flags_sql(base, ISSUES, ('category', 'severity'))}))",
        )
    features = ["l_linenumber", "hint", "l_linestatus"]
    register("target_scores_flagged_lineitem", lambda s, d: _score_rows(s, scoring.quality(_target_evidence(s, d))), _scores_sql(_with_target_sql("flagged_lineitem", "l_returnflag", features), TARGET_PARTS, {}))
    for name, (target, columns) in TARGETS.items():
        base = _with_target_sql(name, target, columns)
        register(f"target_model_scores_{name}", lambda s, d, n=name, y=target: _model_scores(s, _target_models(s, d, n, y)), f"WITH e AS ({base}), f AS ({TARGET_FINGERPRINT_SQL} FROM e), m AS ({_ALL_MODELS}) {TARGET_MODEL_SCORES_SQL}")
    register("model_ranking_orders", lambda s, d: _ranked(s, _target_models(s, d, "orders", "o_orderstatus")), _ranking_sql())
    register("consistency_score_dirty_orders", lambda s, d: _listed(s, [(consistency.check(Q.load(s, d, "dirty_orders")).score,)], "score double"), consistency_sql("dirty_orders", TEXTS.texts))
    register(
        "consistency_columns_dirty_orders",
        lambda s, d: _listed(s, sorted((line.split(": ")[0], c) for line in consistency.check(Q.load(s, d, "dirty_orders")).recommendations() for c in line.split(": ")[1].split(", ")), "advice string, column string"),
        " UNION ALL ".join(
            f"SELECT DISTINCT '{said}' AS advice, \"column\" FROM ({' UNION ALL '.join(f'SELECT {chr(34)}column{chr(34)} FROM ({_rule(r, Q._VALUES)})' for r in rules)})"
            for said, rules in (
                ("Bring mixed columns to one type", ["mixed_types"]),
                ("Turn null-like, placeholder and damaged texts into nulls", ["noise"]),
                ("Use one spelling for each category", ["abbreviation_pairs", "spelling_variants"]),
                ("Use one unit in each column", ["unit_inconsistencies"]),
                ("Use one date or phone format in each column", ["format_inconsistencies"]),
            )
        ),
    )
    register("leak_risks_telling_lineitem", _leak_risks, _leak_risks_sql())
    register("claims_dirty_orders", Q._claims, _claims_sql())
    register("claims_confidence_dirty_orders", _confidence, f"SELECT verified, partial, CASE WHEN verified > 0.8 THEN 'HIGH' WHEN verified + partial > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT round(count(*) FILTER (validation_status = 'VERIFIED') / count(*), 4) AS verified, round(count(*) FILTER (validation_status = 'PARTIAL') / count(*), 4) AS partial FROM ({_claims_sql()}))")
    register("detected_targets", _detected, " UNION ALL ".join(_detected_sql(t, ORDER[t]) for t in DETECT))

    # Rows that samples take.
    src = Q.source("dirty_orders")
    register(
        "mixed_rows_dirty_orders",
        lambda s, d: sampling.mixed_rows(Q.load(s, d, "dirty_orders"), "amount", "o_orderkey").select("o_orderkey", "amount"),
        f"SELECT o_orderkey, amount FROM (SELECT *, row_number() OVER (PARTITION BY {_numeric('amount')} ORDER BY o_orderkey) AS r, count(DISTINCT {_numeric('amount')}) OVER () AS k FROM {src} WHERE amount IS NOT NULL) WHERE r <= 2 AND k = 2",
    )
    register("dominant_rows_mostly_events", lambda s, d: sampling.dominant_rows(Q.load(s, d, "numbered_events"), "kind", "event_id").select("event_id", "kind"), f"SELECT event_id, kind FROM {Q.source('numbered_events')} WHERE kind = (SELECT kind FROM {Q.source('numbered_events')} GROUP BY kind HAVING count(*) > 0.5 * (SELECT count(*) FROM events)) ORDER BY event_id LIMIT 1")
    register(
        "number_format_rows_dirty_orders",
        lambda s, d: sampling.format_rows(Q.load(s, d, "dirty_orders"), "amount", "o_orderkey", sampling.number_kind).select("o_orderkey", "format"),
        f"SELECT min(o_orderkey) AS o_orderkey, format FROM (SELECT o_orderkey, CASE WHEN regexp_matches(v, '[$€£¥]') THEN 'currency' WHEN regexp_matches(v, '^\\d+\\.?\\d*$') THEN 'plain' WHEN regexp_matches(v, '\\d+[eE][+-]?\\d+') THEN 'scientific' WHEN contains(v, '%') AND regexp_matches(v, '\\d') THEN 'percentage' END AS format "
        f"FROM (SELECT o_orderkey, trim(amount) AS v FROM {src} WHERE amount IS NOT NULL)) WHERE format IS NOT NULL GROUP BY format",
    )
    gaps = Q.source("gappy_events")
    register(
        "co_missing_rows_gappy_events",
        lambda s, d: sampling.co_missing_rows(Q.load(s, d, "gappy_events"), 7, "event_id").select("event_id"),
        f"SELECT event_id FROM {gaps} WHERE " + " OR ".join(f"({a} IS NULL AND {b} IS NULL AND " + " AND ".join(f"(SELECT count(*) FILTER ({c} IS NULL) * 100.0 / count(*) FROM {gaps}) > 20" for c in (a, b)) + ")" for a, b in combinations(["event_id", "event_type", "value", "reading", "user_id"], 2)) + " ORDER BY event_id LIMIT 7",
    )
    missing = " + ".join(f"({c} IS NULL)::INTEGER" for c in ["event_id", "event_type", "value", "reading", "user_id"])
    register("fewest_missing_rows_gappy_events", lambda s, d: sampling.baseline_rows(Q.load(s, d, "gappy_events"), "event_id").select("event_id"), f"SELECT event_id FROM {gaps} ORDER BY {missing}, md5(concat('42:', event_id)), event_id LIMIT 3")
    register("blank_rows_gappy_events", lambda s, d: sampling.blank_rows(Q.load(s, d, "gappy_events"), 5, "event_id").select("event_id"), f"SELECT event_id FROM {gaps} WHERE trim(event_type) = '' ORDER BY event_id LIMIT 5")
    register(
        "sample_counts_dirty_orders",
        lambda s, d: _sample_counts(s, d),
        f"SELECT 'mixed_types' AS issue_type, 'amount' AS \"column\" FROM (SELECT 1 FROM {src} WHERE amount IS NOT NULL HAVING count(DISTINCT {_numeric('amount')}) = 2)",
    )
    register(
        "parsing_columns_dirty_orders",
        lambda s, d: _listed(s, [(c,) for c in sampling.parsing_columns(Q.load(s, d, "iso_orders"))], "column string"),
        f"SELECT 'day' AS \"column\" FROM (SELECT * FROM {Q.source('iso_orders')} WHERE day IS NOT NULL) HAVING count(try_strptime(day, '%Y-%m-%d')) > 0.5 * count(*) UNION ALL "
        f"SELECT 'half' FROM (SELECT * FROM {Q.source('iso_orders')} WHERE half IS NOT NULL) HAVING count(try_strptime(half, '%Y-%m-%d')) > 0.5 * count(*)",
    )
    metadata = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS type, 'customer' AS \"table\", count(*) AS rows, 1.5::DOUBLE AS size_mb FROM customer" for i, (c, k) in enumerate((("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
    register("metadata_customer", lambda s, d: report.tables.metadata(Q.load(s, d, "customer"), "customer", 1.5), metadata)
    classes = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS class" for c, k in (("o_orderkey", "numerical"), ("half", "categorical"))) + f" UNION ALL SELECT 'day', CASE WHEN count(day) > 0 AND count(*) FILTER (day IS NOT NULL AND try_strptime(day, '%Y-%m-%d') IS NULL) = 0 THEN 'datetime' ELSE 'categorical' END FROM {Q.source('iso_orders')}"
    register("column_classes_iso_orders", lambda s, d: _listed(s, list(profile.column_classes(Q.load(s, d, "iso_orders")).items()), "column string, class string"), classes)


def _sample_counts(s: SparkSession, d: str) -> DataFrame:
    rows = sampling.stratified(Q.load(s, d, "dirty_orders").select("o_orderkey", "amount"), "o_orderkey")
    return _listed(s, sorted({(r["issue_type"], r["column"]) for r in rows if r["issue_type"] == "mixed_types"}), "issue_type string, column string")
