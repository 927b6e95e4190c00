"""An outside assessor: what it is told, how its answer is read, how far it is trusted.

The assessor is any callable from a dict to a dict or a JSON text; nothing here calls a network.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Assessor = Callable[[dict], "dict | str"]
NUMBER_KEY = "adjusted_quality_score"


def request(quality: dict, samples: list[dict], summary: dict, limit: int = 5) -> dict:
    """What the assessor gets: scores, counts of samples and the first samples of each severity."""
    by = {}
    for s in samples:
        by.setdefault(s["severity"], []).append({"issue_type": s["issue_type"], "column": s["column"], "row": {k: None if v is None else str(v) for k, v in s["row"].items()}})
    return {"quality": quality, "summary": summary, "samples": {k: v[:limit] for k, v in by.items()}}


def parse_answers(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON from free text by the first of these that works: the text itself, a fenced block, the outermost braces, those
    with trailing commas mended, single fields of a broken object, and numbers behind a field's words in prose ("score is 62").
    Adds ``parsed`` (null if none) and ``strategy``. ``schema`` is a flat one; of lists and structs only whole objects give values."""
    text = F.col(column)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(braces, r",\s*([}\]])", "$1")
    tries = [("direct", text), ("fenced", fenced), ("braces", braces), ("mended", mended)]
    ok = lambda t: F.try_parse_json(t).isNotNull() & F.startswith(F.trim(t), F.lit("{"))
    chosen: Column = F.lit(None).cast("string")
    strategy: Column = F.lit(None).cast("string")
    for name, t in reversed(tries):
        chosen, strategy = F.when(ok(t), t).otherwise(chosen), F.when(ok(t), F.lit(name)).otherwise(strategy)
    fields = T._parse_datatype_string(schema).fields
    whole = F.from_json(chosen, schema)
    for name, reader in (("partial", _in_part), ("prose", _in_prose)):
        loose = [reader(text, f) for f in fields]
        use = strategy.isNull() & F.coalesce(*[F.when(v.isNotNull(), True) for v in loose], F.lit(False))
        strategy, whole = F.when(use, F.lit(name)).otherwise(strategy), F.when(use, F.struct(*[v.alias(f.name) for v, f in zip(loose, fields)])).otherwise(whole)
    return df.withColumn("strategy", strategy).withColumn("parsed", whole)


def _in_part(text: Column, f: T.StructField) -> Column:
    """A field's value from a piece of JSON."""
    if isinstance(f.dataType, T.StringType):
        return F.nullif(F.regexp_extract(text, rf'"{f.name}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
        return F.nullif(F.regexp_extract(text, rf'"{f.name}"\s*:\s*"?(-?[0-9.]+|true|false)', 1), F.lit("")).try_cast(f.dataType)
    return F.lit(None).cast(f.dataType)


def _in_prose(text: Column, f: T.StructField) -> Column:
    """A number that follows the field's words within a few others."""
    if isinstance(f.dataType, T.NumericType):
        words = f.name.replace("_", r"[\s_-]+")
        return F.nullif(F.regexp_extract(text, rf"(?i)\b{words}\b[^0-9{{}}]{{0,30}}?(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast(f.dataType)
    return F.lit(None).cast(f.dataType)


def read_answer(answer: dict | str) -> dict:
    """A dict from an answer; numbers coerced, the score held within 0 to 100, lists never missing."""
    if isinstance(answer, str):
        start, end = answer.find("{"), answer.rfind("}")
        try:
            answer = json.loads(answer[start : end + 1])
        except ValueError:
            return {"error": "no JSON object"}
    answer = dict(answer)
    try:
        answer[NUMBER_KEY] = max(0.0, min(100.0, float(answer[NUMBER_KEY])))
    except (KeyError, TypeError, ValueError):
        answer.pop(NUMBER_KEY, None)
    for key in ("blocking_issues", "recommended_fixes", "biggest_red_flags"):
        if not isinstance(answer.get(key), list):
            answer[key] = []
    return answer


def confidence(answer: dict) -> tuple[int, str]:
    """Percent and level, from the stated confidence, evidence, completeness and the number of samples."""
    evidence = sum(0.1 if len(i.get("sample_evidence", [])) >= 2 else 0.05 if i.get("sample_evidence") else 0.0 for i in answer.get("blocking_issues", []))
    complete = sum(bool(answer.get(k)) for k in (NUMBER_KEY, "blocking_issues", "recommended_fixes")) / 3 * 0.2
    samples = answer.get("samples_analyzed", 0)
    total = {"HIGH": 0.4, "MEDIUM": 0.25}.get(answer.get("confidence_level", "MEDIUM"), 0.1) + min(evidence, 0.3) + complete
    total += 0.05 if samples > 20 else 0.03 if samples > 10 else 0.01 if samples > 0 else 0.0
    total += 0.05 if answer.get("critical_issues_found", 0) > 0 and answer.get("blocking_issues") else 0.0
    percent = int(min(total, 1.0) * 100)
    return percent, next((n for least, n in [(80, "VERY_HIGH"), (65, "HIGH"), (50, "MEDIUM"), (35, "LOW")] if percent >= least), "VERY_LOW")


def reliability(level: str, answer: dict) -> str:
    if level in ("VERY_HIGH", "HIGH"):
        return "RELIABLE"
    if level != "MEDIUM":
        return "UNRELIABLE"
    shown = any(i.get("severity") == "CRITICAL" and i.get("sample_evidence") for i in answer.get("blocking_issues", []))
    return "MODERATELY_RELIABLE" if shown else "QUESTIONABLE"


def agreement(answer: dict, own_score: float, summary: dict) -> dict[str, float]:
    """How well the answer's score and severities agree with the scores and samples it was given."""
    gap = abs(answer.get(NUMBER_KEY, own_score) - own_score)
    scores = next((v for most, v in [(5, 1.0), (10, 0.8), (20, 0.6), (30, 0.4)] if gap <= most), 0.2)
    has = lambda s: any(i.get("severity") == s for i in answer.get("blocking_issues", []))
    samples = sum(0.5 for s in ("CRITICAL", "HIGH") if (summary.get(f"{s.lower()}_count", 0) > 0) == has(s))
    return {"score_alignment": scores, "sample_alignment": samples, "overall_consistency": scores * 0.5 + samples * 0.5}


IMPACTS = {"CRITICAL": ("HIGH", "4-6 hours"), "HIGH": ("HIGH", "4-6 hours"), "MEDIUM": ("MEDIUM", "2-4 hours"), "LOW": ("LOW", "1-2 hours")}
FIX_EFFORT = {
    "mixed_data_types": ("HIGH", "4-8 hours"), "semantic_nulls": ("HIGH", "4-8 hours"),
    "format_inconsistencies": ("MEDIUM", "2-4 hours"), "number_format_mix": ("MEDIUM", "2-4 hours"),
}


def insights(answer: dict) -> dict | None:
    """Summary, at most eight action items (five issues and three fixes) and a pipeline, or None without an answer."""
    if not answer or "error" in answer:
        return None
    item = lambda action, rank: {"action": action, "impact": rank[0], "effort": rank[1]}
    issues = [item(i.get("description", "Address the issue"), IMPACTS.get(i.get("severity"), ("MEDIUM", "2-4 hours"))) for i in answer.get("blocking_issues", [])[:5]]
    fixes = [item(f.get("fix_description", "Apply the fix"), FIX_EFFORT.get(f.get("issue_type"), ("MEDIUM", "1-3 hours"))) for f in answer.get("recommended_fixes", [])[:3]]
    code = [f"# {f.get('fix_description', 'Fix')}\n{f['python_code']}" for f in answer.get("recommended_fixes", [])[:5] if "python_code" in f]
    return {
        "summary": answer.get("severity_explanation", ""),
        "red_flags": answer.get("biggest_red_flags", [])[:3],
        "action_items": (issues + fixes)[:8],
        "pipeline": "\n\n".join(code),
    }


def fallback(issues: list[dict]) -> dict:
    """Summary and actions when there is no assessor: counts by severity and the first five issues."""
    n = {s: sum(i["severity"] == s for i in issues) for s in ("high", "medium", "low")}
    return {"summary": f"{n['high']} high, {n['medium']} medium and {n['low']} low issues", "action_items": [i["recommendation"] for i in issues[:5]]}
