"""Checking claims about a table against its data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions import catalogs as C
from dqengine.functions import exprs as E
from dqengine.operators import profile, sampling

KINDS = ["mixed", "semantic_null", "format", "missing", "outlier", "duplicate", "correlation"]


def semantic_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, n, pct of rows for values that stand for null."""
    names = E.string_columns(df) if columns is None else columns
    counts = profile.value_counts(df, names).groupBy("column", E.normal(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    total = counts.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("_all"))
    hits = counts.where(F.col("value").isin(C.CLAIM_NULL_TOKENS))
    return hits.join(total, F.col("column") == F.col("_c")).select("column", "value", "n", E.percent(F.col("n"), F.col("_all")).alias("pct"))


def _first(df: DataFrame, key: str, head: int | None) -> DataFrame:
    return df if head is None else df.orderBy(E.q(key)).limit(head)


def mixed_shares(df: DataFrame, column: str, key: str, head: int | None = None) -> DataFrame:
    """numeric, number_words, other shares of all values, or of the first ``head`` (the reference takes 200)."""
    first = df.where(E.q(column).isNotNull()).transform(_first, key, head)
    v = E.q(column).cast("string")
    word = reduce(lambda a, b: a | b, [E.normal(v).contains(w) for w in C.NUMBER_WORDS])
    n = F.count(F.lit(1))
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), n)
    return first.agg(share(E.is_numeric(v)).alias("numeric"), share(~E.is_numeric(v) & word).alias("number_words"), share(~E.is_numeric(v) & ~word).alias("other"))


def date_kinds(df: DataFrame, column: str, key: str, head: int | None = None) -> DataFrame:
    """kind, n of values over five characters with a digit: slash, dash or dot."""
    v = F.trim(E.q(column).cast("string"))
    first = df.where(E.q(column).isNotNull()).transform(_first, key, head).where((F.length(v) > 5) & v.rlike(r"\d"))
    kind = F.when(v.contains("/"), "slash").when(v.contains("-"), "dash").when(v.contains("."), "dot")
    return first.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind is not null")


def number_kinds(df: DataFrame, column: str, key: str, head: int | None = None) -> DataFrame:
    v = F.trim(E.q(column).cast("string"))
    first = df.where(E.q(column).isNotNull()).transform(_first, key, head)
    return first.groupBy(sampling.number_kind(v).alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind is not null")


DATES, NUMBERS = ("slash", "dash", "dot"), ("currency", "plain", "scientific", "percentage")


def column_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column what claims of its texts are checked against: null_like (values that stand for null), shares numeric, words and
    other, and counts of the kinds of dates and numbers. Rules look at each distinct value once; columns without values have no row."""
    counts = profile.value_counts(df, columns).where("value is not null")
    v, trimmed = F.col("value"), F.trim(F.col("value"))
    numeric, word = E.is_numeric(v), reduce(lambda a, b: a | b, [E.normal(v).contains(w) for w in C.NUMBER_WORDS])
    dated = (F.length(trimmed) > 5) & trimmed.rlike(r"\d")
    date = F.when(dated, F.when(trimmed.contains("/"), "slash").when(trimmed.contains("-"), "dash").when(trimmed.contains("."), "dot"))
    judged = counts.select("column", "n", E.normal(v).isin(C.CLAIM_NULL_TOKENS).alias("is_null"), F.when(numeric, "numeric").when(word, "words").otherwise("other").alias("type"), date.alias("date"), sampling.number_kind(trimmed).alias("number"))
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("double")
    shares = [F.try_divide(some(F.col("type") == t), F.sum("n")).alias(t) for t in ("numeric", "words", "other")]
    kinds = [some(F.col(c) == k).alias(k) for c, many in (("date", DATES), ("number", NUMBERS)) for k in many]
    return judged.groupBy("column").agg(some(F.col("is_null")).alias("null_like"), *shares, *kinds)


def _varied(kinds: tuple[str, ...], least: float) -> Column:
    """Whether over ten values fall into two or more kinds that each have more than that share."""
    total = sum((F.col(k) for k in kinds), F.lit(0.0))
    return (total > 10) & (sum(((F.col(k) > least * total).cast("int") for k in kinds), F.lit(0)) > 1)


def kind_of(claim: dict) -> str | None:
    return next((k for k in KINDS if k in claim.get("issue_type", "").lower()), None)


def claim_evidence(df: DataFrame, claims: list[dict]) -> DataFrame:
    """claim (its place), issue_type, validation_status and evidence: the mean missing or outlier percentage of its columns, how many of them
    are mixed, varied or hold null-like values, how many rows are duplicates, or how many pairs are correlated by more than 0.7.

    Claims are a table that is joined to the facts of the columns that they name; facts are gathered once for all claims, and only
    those that some claim asks for. Columns that the table doesn't have are no evidence."""
    spark = df.sparkSession
    named = [[c for c in claim.get("affected_columns", []) if c in df.columns] for claim in claims]
    kinds = [kind_of(c) for c in claims]
    rows = [(i, c.get("issue_type", ""), k, names) for i, (c, k, names) in enumerate(zip(claims, kinds, named))]
    table = spark.createDataFrame(rows, "claim long, issue_type string, kind string, columns array<string>")
    of = lambda *wanted: list(dict.fromkeys(c for k, names in zip(kinds, named) if k in wanted for c in names))
    numbers = set(E.numeric_columns(df))
    facts = column_facts(df, of("mixed", "semantic_null", "format")).withColumnRenamed("column", "_fact")
    gone = profile.missing(df.select(*[E.q(c) for c in of("missing")])).select(F.col("column").alias("_gone"), "missing_pct")
    fences = profile.outliers(df, [c for c in of("outlier") if c in numbers]).select(F.col("column").alias("_fence"), "outlier_pct")
    pairs = profile.high_correlations(df, 0.7, [c for c in of("correlation") if c in numbers]).select(F.array_sort(F.array("column_a", "column_b")).alias("_pair"))
    repeated = profile.duplicates(df).select(F.lit("duplicate").alias("_kind"), F.col("duplicate_rows").cast("double")) if "duplicate" in kinds else spark.createDataFrame([], "_kind string, duplicate_rows double")

    each = table.withColumn("_column", F.explode_outer("columns")).join(F.broadcast(facts), F.col("_column") == F.col("_fact"), "left").join(F.broadcast(gone), F.col("_column") == F.col("_gone"), "left").join(F.broadcast(fences), F.col("_column") == F.col("_fence"), "left")
    mixed = (F.coalesce("numeric", F.lit(0.0)) > 0.05) & (F.greatest(F.coalesce("words", F.lit(0.0)), F.coalesce("other", F.lit(0.0))) > 0.05)
    found = each.groupBy("claim", "issue_type", "kind", "columns").agg(
        F.avg("missing_pct").alias("missing"), F.avg("outlier_pct").alias("outlier"), F.count_if(F.col("null_like") > 0).alias("nulls"), F.count_if(mixed).alias("mixed"), F.count_if(_varied(DATES, 0.05) | _varied(NUMBERS, 0.1)).alias("varied")
    )
    # A pair is evidence of every claim that names both of its columns.
    linked = table.where("kind = 'correlation'").select(F.col("claim").alias("_claim"), F.explode(F.array_distinct("columns")).alias("a"), "columns")
    linked = linked.select("_claim", "a", F.explode(F.array_distinct("columns")).alias("b")).where("a < b").join(F.broadcast(pairs), F.col("_pair") == F.array("a", "b"))
    found = found.join(linked.groupBy("_claim").agg(F.count(F.lit(1)).alias("pairs")), F.col("claim") == F.col("_claim"), "left").join(F.broadcast(repeated), F.col("kind") == F.col("_kind"), "left")
    values = {"mixed": F.col("mixed"), "semantic_null": F.col("nulls"), "format": F.col("varied"), "missing": F.col("missing"), "outlier": F.col("outlier"), "duplicate": F.col("duplicate_rows"), "correlation": F.coalesce("pairs", F.lit(0))}
    evidence = reduce(lambda at, kv: at.when(F.col("kind") == kv[0], kv[1].cast("double")), values.items(), F.when(F.lit(False), F.lit(None).cast("double")))
    # Missing values and outliers are confirmed by being measured, however few there are.
    holds = F.when(F.col("kind").isin("missing", "outlier"), evidence.isNotNull()).otherwise(F.coalesce(evidence > 0, F.lit(False)))
    status = F.when(holds, "VERIFIED").when(F.col("kind") == "format", "PARTIAL").otherwise("UNVERIFIED")
    return found.select("claim", "issue_type", status.alias("validation_status"), evidence.alias("evidence"))


def validate(df: DataFrame, claims: list[dict], key: str | None = None) -> dict:
    """The claims with validation_status and evidence, their rates and the confidence that follows."""
    found = {r.claim: r for r in claim_evidence(df, claims).collect()} if claims else {}
    checked = [claim | {"validation_status": found[i].validation_status, "evidence": found[i].evidence} for i, claim in enumerate(claims)]
    n = len(checked)
    rate = sum(c["validation_status"] == "VERIFIED" for c in checked) / n if n else 1.0
    partial = sum(c["validation_status"] == "PARTIAL" for c in checked) / n if n else 0.0
    return {"claims": checked, "verified_rate": rate, "partial_rate": partial, "confidence": confidence(rate, partial)}


def confidence(verified: float, partial: float) -> str:
    return "HIGH" if verified > 0.8 else "MEDIUM" if verified + partial > 0.6 else "LOW"
