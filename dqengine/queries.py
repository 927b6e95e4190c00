"""Registry of the engine's own queries and their SQL twins, over the driver's tables and dirty projections of them.

A projection is the same list of SQL expressions on both sides; everything after it is the operator here and plain SQL there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.functions import catalogs as C
from dqengine.functions.lineage import shared_dir
from dqengine.operators import baseline, consistency, importance, leakage, neighbours, profile, sampling, sketches, telling, validation
from dqengine.plans import assess, display, growing, models, report, scoring
from dqengine.streaming import profile as streaming

DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
PROJECTIONS = {
    "dirty_lineitem": (
        "lineitem",
        [
            "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice",
            "CASE WHEN l_orderkey % 101 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS l_quantity",
            "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount",
            "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_tax END AS l_tax",
        ],
    ),
    "leaky_lineitem": (
        "lineitem",
        ["l_quantity", "l_extendedprice", "l_discount", "l_quantity * 2 + 1 AS twin", "CAST(1.0 AS DOUBLE) AS fixed", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity + l_tax * 10 END AS close"],
    ),
    "flagged_lineitem": (
        "lineitem",
        ["l_returnflag", "CASE WHEN l_returnflag = 'A' AND l_orderkey % 2 = 0 THEN 'only' ELSE 'mixed' END AS hint", "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus", "l_linenumber"],
    ),
    "rare_lineitem": ("lineitem", ["l_linenumber", "l_linestatus", "l_returnflag", "CASE WHEN l_orderkey % 40 = 0 THEN 'rare' ELSE 'usual' END AS kind"]),
    "sure_lineitem": ("lineitem", ["l_linenumber", "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus", "concat('only ', l_returnflag) AS sure", "l_returnflag"]),
    "dirty_orders": (
        "orders",
        [
            "o_orderkey", "o_orderstatus",
            "CASE WHEN o_orderkey % 23 = 0 THEN 'N/A' WHEN o_orderkey % 29 = 0 THEN '-' WHEN o_orderkey % 31 = 0 THEN 'test1' WHEN o_orderkey % 37 = 0 THEN 'caf&eacute;' "
            "WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat(' ', lower(o_orderpriority)) ELSE o_orderpriority END AS priority",
            "CASE WHEN o_orderkey % 4 = 0 THEN concat('$', CAST(o_custkey AS STRING)) WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS STRING) "
            "WHEN o_orderkey % 4 = 2 THEN concat(CAST(o_orderkey % 90 AS STRING), ' percent') ELSE 'thirty' END AS amount",
            f"CASE WHEN o_orderkey % 3 = 0 THEN {DAY} WHEN o_orderkey % 3 = 1 THEN concat(substr({DAY}, 6, 2), '/', substr({DAY}, 9, 2), '/', substr({DAY}, 1, 4)) "
            f"ELSE concat(substr({DAY}, 9, 2), '-', substr({DAY}, 6, 2), '-', substr({DAY}, 1, 4)) END AS day_text",
            "CASE WHEN o_orderkey % 2 = 0 THEN concat('555-010-', CAST(1000 + o_orderkey % 9000 AS STRING)) ELSE concat('(555) 010-', CAST(1000 + o_orderkey % 9000 AS STRING)) END AS phone",
            "CASE WHEN o_orderkey % 5 = 0 THEN 'm' WHEN o_orderkey % 5 = 1 THEN 'female' WHEN o_orderkey % 5 = 2 THEN 'Male' WHEN o_orderkey % 5 = 3 THEN 'f' ELSE 'MALE ' END AS sex",
        ],
    ),
    "noted_events": ("events", ["event_id", "event_type", "value", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS reading", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id"]),
    "numbered_events": ("events", ["event_id", "CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'usual' END AS kind"]),
    "gappy_events": ("events", ["event_id", "CASE WHEN event_id % 8 = 1 THEN ' ' ELSE event_type END AS event_type", "CASE WHEN event_id % 10 < 9 THEN NULL ELSE value END AS value", "CASE WHEN event_id % 10 > 7 THEN NULL ELSE value END AS reading", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id"]),
    "iso_orders": ("orders", ["o_orderkey", f"CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {DAY} END AS day", f"CASE WHEN o_orderkey % 3 = 0 THEN {DAY} ELSE 'soon' END AS half"]),
    "telling_lineitem": ("lineitem", ["l_returnflag", "concat('only ', l_returnflag) AS sure", "CASE WHEN l_returnflag = 'A' THEN 'only' ELSE 'mixed' END AS hint", "l_linestatus", "l_orderkey AS order_id", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_shipdate END AS ship_date"]),
    "mostly_events": ("events", ["CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'usual' END AS kind", "CASE WHEN event_id % 4 = 0 THEN 'x' ELSE 'nan' END AS filler", "event_type"]),
    "flags_labels": ("labels", ["quality", "toxic", "CASE WHEN quality = 1 THEN 'yes' ELSE 'No' END AS answer", "doc_id", "quality = 1 AS flag", "CASE WHEN doc_id < 0 THEN 1 ELSE NULL END AS nothing"]),
    "dup_orders": ("(SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 = 0)", ["*"]),
    "dated_lines": ("(SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey)", ["o_orderkey", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS order_date", "CASE WHEN l_orderkey % 13 = 0 THEN o_orderdate - INTERVAL '3' DAY ELSE l_shipdate END AS ship_date"]),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a projection of one (or of a small query over several)."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, expressions = PROJECTIONS[name]
    if base in TABLES:
        return load(spark, sf_dir, base).selectExpr(*expressions)
    if name == "dup_orders":
        orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        return orders.unionByName(orders.where("o_orderkey % 10 = 0")).drop("o_orderkey")
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.selectExpr(*expressions)


def source(name: str) -> str:
    """The same as a subquery."""
    if name in TABLES:
        return name
    base, expressions = PROJECTIONS[name]
    return f"(SELECT {', '.join(expressions)} FROM {base}) AS t"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# SQL for what several twins share.
NORM = "lower(trim(value))"
IS_NUMERIC = f"(regexp_full_match(trim(value), '{C.NUMERIC}') OR {NORM} IN ({quoted(C.NUMERIC_WORDS)}))"


def begins(value: str, patterns: list[str]) -> str:
    return f"regexp_matches({value}, '^(?:{'|'.join(f'(?:{p})' for p in patterns)})')"


CLASS = (
    f"CASE WHEN {IS_NUMERIC} THEN 'numeric' WHEN {NORM} IN ({quoted(C.NUMBER_WORDS)}) OR {begins(NORM, [C.ORDINAL])} THEN 'text_numeric' "
    f"WHEN {NORM} IN ({quoted(C.BOOLEAN_TOKENS)}) THEN 'boolean_like' WHEN {begins('trim(value)', C.DATETIME_STARTS)} THEN 'datetime_like' ELSE 'categorical' END"
)
IS_NULL_NOISE, IS_PLACEHOLDER = f"{NORM} IN ({quoted(C.NULL_TOKENS)})", begins(NORM, C.PLACEHOLDERS)
IS_ENCODING = f"(contains(value, chr(65533)) OR contains(value, '\\x') OR contains(value, '\\u') OR regexp_matches(value, '{C.ENTITY}'))"


def cells(name: str, columns: list[str]) -> str:
    """column, value of all string cells that are not null."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {source(name)} WHERE {c} IS NOT NULL" for c in columns)


def counted(name: str, columns: list[str]) -> str:
    return f'SELECT "column", value, count(*) AS n FROM ({cells(name, columns)}) GROUP BY ALL'


Query = tuple[Callable[[SparkSession, str], DataFrame], "str | None"]
REGISTRY: dict[str, Query] = {}


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    REGISTRY[name] = (make, sql)


# Numeric statistics.
NUMERIC = {
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"],
    "orders": ["o_totalprice"],
    "part": ["p_size", "p_retailprice"],
    "customer": ["c_acctbal"],
    "events": ["value"],
    "dirty_lineitem": ["l_quantity", "l_discount", "l_tax"],
    "leaky_lineitem": ["fixed", "close"],
}


def _summary_sql(name: str, columns: list[str]) -> str:
    moment = lambda f, c: f"CASE WHEN var_pop(CAST({c} AS DOUBLE)) = 0 THEN 0.0 ELSE {f}(CAST({c} AS DOUBLE)) END"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max, round({moment('skewness', c)}, 4) AS skewness, round({moment('kurtosis', c)}, 4) AS kurtosis FROM {source(name)}"
        for c in columns
    )


for _t, _columns in NUMERIC.items():
    register(f"num_summary_{_t}", lambda s, d, t=_t, c=_columns: rounded(profile.numeric_summary(load(s, d, t), c)), _summary_sql(_t, _columns))


def _outlier_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({c} < lo OR {c} > hi) AS DOUBLE) AS outliers, coalesce(round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count({c}), 2), 0.0) AS outlier_pct, "
        f"round(any_value(lo), 4) AS lower, round(any_value(hi), 4) AS upper FROM {source(name)}, "
        f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source(name)})) AS b"
        for c in columns
    )


for _t in ("dirty_lineitem", "orders", "part"):
    register(f"iqr_outliers_{_t}", lambda s, d, t=_t: rounded(profile.outliers(load(s, d, t), NUMERIC[t])), _outlier_sql(_t, NUMERIC[_t]))


def _pairs_sql(name: str, columns: list[str]) -> str:
    both = lambda a, b: f"FROM {source(name)} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(CASE WHEN stddev_samp({a}) * stddev_samp({b}) = 0 THEN NULL ELSE covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END, 3) AS r {both(a, b)}"
        for a, b in combinations(columns, 2)
    )


_LEAKY = ["l_quantity", "l_extendedprice", "l_discount", "twin", "fixed", "close"]
for _t, _columns in {"lineitem": NUMERIC["lineitem"], "dirty_lineitem": NUMERIC["dirty_lineitem"], "leaky_lineitem": _LEAKY}.items():
    register(f"correlations_{_t}", lambda s, d, t=_t, c=_columns: rounded(profile.correlations(load(s, d, t), c), 3), _pairs_sql(_t, _columns))
register("high_correlations_leaky_lineitem", lambda s, d: rounded(profile.high_correlations(load(s, d, "leaky_lineitem")), 3), f"SELECT * FROM ({_pairs_sql('leaky_lineitem', _LEAKY)}) WHERE abs(r) > 0.8")
register(
    "target_correlations_leaky_lineitem",
    lambda s, d: leakage.target_correlations(load(s, d, "leaky_lineitem"), "l_quantity"),
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_quantity), 4) AS r, CASE WHEN abs(corr({c}, l_quantity)) >= 0.99 THEN 'perfect' ELSE 'near' END AS leak FROM {source('leaky_lineitem')} WHERE {c} IS NOT NULL" for c in ("l_extendedprice", "l_discount", "twin", "close"))
    + ") WHERE abs(r) >= 0.95",
)

# Missing values and duplicates.
_MISSING = ["event_id", "event_type", "value", "reading", "user_id"]
register(
    "missing_noted_events",
    lambda s, d: profile.missing(load(s, d, "noted_events")).withColumn("missing", F.col("missing").cast("long")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS missing_pct FROM {source('noted_events')}" for c in _MISSING),
)
_PER_ROW = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _MISSING)
register("missing_summary_noted_events", lambda s, d: profile.missing_summary(load(s, d, "noted_events")).withColumn("total_missing", F.col("total_missing").cast("long")), f"SELECT CAST(sum({_PER_ROW}) AS BIGINT) AS total_missing, round(sum({_PER_ROW}) * 100.0 / (count(*) * 5), 2) AS missing_pct, count(*) FILTER ({_PER_ROW} = 0) AS complete_rows FROM {source('noted_events')}")
register("row_missing_histogram_noted_events", lambda s, d: profile.row_missing_histogram(load(s, d, "noted_events")), f"SELECT CAST({_PER_ROW} AS INTEGER) AS missing_columns, count(*) AS rows FROM {source('noted_events')} GROUP BY 1")


def _merged_states(s: SparkSession, d: str) -> DataFrame:
    """States of three parts of a table, merged and read."""
    df = load(s, d, "noted_events")
    parts = [sketches.sketch(df.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == r)) for r in range(3)]
    found = sketches.read(sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    return rounded(found.select("column", "rows", "missing", "missing_pct", "mean", "std", "min", "max", "skewness", "kurtosis", F.when(~F.col("numeric"), F.col("top")[0]["n"]).alias("mode_count")))


def _merged_states_sql() -> str:
    src = source("noted_events")
    number = lambda c: f"CAST(CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c} END AS DOUBLE)"
    numbers = [
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({number(c)} IS NULL) AS missing, round(count(*) FILTER ({number(c)} IS NULL) * 100.0 / count(*), 2) AS missing_pct, round(avg({number(c)}), 4) AS mean, round(stddev_samp({number(c)}), 4) AS std, "
        f"min({number(c)}) AS min, max({number(c)}) AS max, round(skewness({number(c)}), 4) AS skewness, round(kurtosis({number(c)}), 4) AS kurtosis, CAST(NULL AS BIGINT) AS mode_count FROM {src}"
        for c in ("event_id", "value", "reading", "user_id")
    ]
    text = f"SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), round(count(*) FILTER (event_type IS NULL) * 100.0 / count(*), 2), NULL, NULL, NULL, NULL, NULL, NULL, (SELECT max(n) FROM (SELECT count(*) AS n FROM {src} WHERE event_type IS NOT NULL GROUP BY event_type)) FROM {src}"
    return " UNION ALL ".join([*numbers, text])


register("merged_states_noted_events", _merged_states, _merged_states_sql())


def _merged_pairs(s: SparkSession, d: str) -> DataFrame:
    """Correlations from the pair moments of three parts of a table."""
    df = load(s, d, "lineitem").select(*_PAIRED)
    parts = [growing.pair_moments(df.where(F.pmod(F.xxhash64(*_PAIRED), F.lit(3)) == r)) for r in range(3)]
    return rounded(growing.pair_correlations(growing.merged_pairs(parts[0].unionByName(parts[1]).unionByName(parts[2]))), 3)


_PAIRED = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
register("merged_pairs_lineitem", _merged_pairs, _pairs_sql("lineitem", _PAIRED))
register("co_missing_noted_events", lambda s, d: profile.co_missing(load(s, d, "noted_events")), f"SELECT 'reading' AS column_a, 'user_id' AS column_b, count(*) AS both_missing FROM {source('noted_events')} WHERE reading IS NULL AND user_id IS NULL HAVING count(*) > 0")


def _duplicates_sql(query: str) -> str:
    return f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, round((sum(n) - count(*)) * 100.0 / sum(n), 2) AS duplicate_pct, count(*) AS unique_rows FROM (SELECT count(*) AS n FROM ({query}) GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY " + query[len("SELECT ") : query.index(" FROM")])


register("duplicates_dup_orders", lambda s, d: profile.duplicates(load(s, d, "dup_orders")), _duplicates_sql(f"SELECT o_custkey, o_orderstatus, o_orderpriority FROM {source('dup_orders')}"))
register("duplicates_document_texts", lambda s, d: profile.duplicates(load(s, d, "documents").select("text")), _duplicates_sql("SELECT text FROM documents"))
register("duplicates_conversation_roles", lambda s, d: profile.duplicates(load(s, d, "conversations").select("role", "turn")), _duplicates_sql("SELECT role, turn FROM conversations"))
register("duplicate_flags_documents", lambda s, d: profile.duplicate_flags(load(s, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "is_duplicate"), "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
register("basic_info_documents", lambda s, d: profile.basic_info(load(s, d, "documents")), "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, CAST(count(*) * 16 + sum(length(text) + 8) + sum(length(lang) + 8) + sum(length(source) + 8) AS BIGINT) AS value_bytes FROM documents")

register(
    "metric_table_noted_events",
    lambda s, d: display.metric_table(load(s, d, "noted_events"), 512.0),
    "SELECT unnest(['total_rows', 'total_columns', 'complete_rows', 'unique_rows', 'duplicate_rows', 'missing_pct', 'size_gb']) AS metric, unnest([n, 5, c, u, n - u, p, 0.5]) AS value FROM ("
    f"SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({_PER_ROW} = 0) AS DOUBLE) AS c, round(sum({_PER_ROW}) * 100.0 / (count(*) * 5), 2) AS p, CAST(count(DISTINCT event_id) AS DOUBLE) AS u FROM {source('noted_events')})",
)

# Categories.
CATEGORIES = {"orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand", "p_type"], "dirty_orders": ["o_orderstatus", "priority", "amount", "day_text", "phone", "sex"]}
for _t, _columns in CATEGORIES.items():
    register(
        f"categorical_features_{_t}",
        lambda s, d, t=_t, c=_columns: profile.categorical_features(load(s, d, t), c),
        f'SELECT "column", count(*) AS n_unique, CASE WHEN count(*) > 50 THEN \'high\' WHEN count(*) > 10 THEN \'medium\' ELSE \'low\' END AS cardinality, arg_min(value, struct_pack(k := -n, v := value)) AS mode, max(n) AS mode_count FROM ({counted(_t, _columns)}) GROUP BY "column"',
    )
    register(
        f"top_values_{_t}",
        lambda s, d, t=_t, c=_columns: profile.top_values(load(s, d, t), c).withColumn("rank", F.col("rank").cast("long")),
        f'SELECT * FROM (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({counted(_t, _columns)})) WHERE rank <= 3',
    )
register("value_counts_orders", lambda s, d: profile.value_counts(load(s, d, "orders"), CATEGORIES["orders"]), counted("orders", CATEGORIES["orders"]))
register(
    "dominant_values_mostly_events",
    lambda s, d: rounded(profile.dominant_values(load(s, d, "mostly_events"))),
    f"""SELECT "column", value, n, round(share, 4) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS share FROM ({counted('mostly_events', ['kind', 'filler', 'event_type'])})) WHERE share > 0.5 AND {NORM} NOT IN ('', 'nan')""",
)
register(
    "numeric_features_leaky_lineitem",
    lambda s, d: rounded(profile.numeric_features(load(s, d, "leaky_lineitem"), ["l_discount", "fixed", "close"])),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(var_samp({c}), 4) AS variance, coalesce(var_samp({c}) < 0.01, false) AS low_variance, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) <= 1 AS is_constant FROM {source('leaky_lineitem')}" for c in ("l_discount", "fixed", "close")),
)
register(
    "unique_ratio_orders",
    lambda s, d: rounded(profile.unique_ratio(load(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count(*), 4) AS ratio, count(DISTINCT {c}) / count(*) > 0.95 AS almost_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderpriority")),
)
register(
    "binary_columns_flags_labels",
    lambda s, d: profile.binary_columns(load(s, d, "flags_labels")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (NOT ({test})) = 0 AS is_binary FROM {source('flags_labels')}" for c, test in {"quality": "quality IN (0, 1)", "toxic": "toxic IN (0, 1)", "answer": "lower(answer) IN ('yes', 'no')", "doc_id": "doc_id IN (0, 1)", "flag": "true", "nothing": "nothing IS NULL"}.items()),
)

# Targets.
for _t, _c in (("labels", "toxic"), ("lineitem", "l_returnflag"), ("orders", "o_orderpriority")):
    register(
        f"class_balance_{_t}",
        lambda s, d, t=_t, c=_c: rounded(profile.class_balance(load(s, d, t), c)),
        f"SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows, max(n) < 0.6 * sum(n) AS balanced, round(max(n) / min(n), 4) AS imbalance_ratio, arg_min(label, struct_pack(k := -n, l := label)) AS majority, arg_min(label, struct_pack(k := n, l := label)) AS minority FROM (SELECT CAST({_c} AS VARCHAR) AS label, count(*) AS n FROM {_t} GROUP BY 1)",
    )
_TYPES = {"labels": ("quality", "whole"), "lineitem": ("l_extendedprice", "real"), "orders": ("o_orderstatus", "text"), "events": ("value", "real"), "part": ("p_size", "whole")}


def _problem_sql(table: str, column: str, kind: str) -> str:
    rule = "'classification'" if kind == "text" else f"CASE WHEN u < 0.05 * rows OR ({str(kind == 'whole').lower()} AND v <= 20) THEN 'classification' ELSE 'regression' END"
    return f"SELECT '{column}' AS \"column\", u AS n_unique, rows, {rule} AS problem_type FROM (SELECT count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) AS u, count(DISTINCT {column}) AS v, count(*) AS rows FROM {table})"


for _t, (_c, _k) in _TYPES.items():
    register(f"problem_type_{_t}", lambda s, d, t=_t, c=_c: profile.problem_type(load(s, d, t), c), _problem_sql(_t, _c, _k))
register(
    "target_statistics_orders",
    lambda s, d: rounded(profile.target_statistics(load(s, d, "orders"), "o_totalprice")),
    f"SELECT \"column\", mean, std, min, max, skewness, kurtosis FROM ({_summary_sql('orders', ['o_totalprice'])})",
)

# Leakage.
_FLAGGED = ["hint", "l_linestatus", "l_linenumber"]
_PREDICTORS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(sum(n) FILTER (v IS NOT NULL AND k = 1), 0) / sum(n) AS ratio FROM (SELECT {c} AS v, count(DISTINCT l_returnflag) AS k, count(*) AS n FROM {source('flagged_lineitem')} GROUP BY 1)" for c in _FLAGGED
)
register("perfect_predictors_flagged_lineitem", lambda s, d: rounded(leakage.perfect_predictors(load(s, d, "flagged_lineitem"), "l_returnflag")), f'SELECT "column", round(ratio, 4) AS ratio FROM ({_PREDICTORS})')
register(
    "predictor_leaks_flagged_lineitem",
    lambda s, d: rounded(leakage.predictor_leaks(load(s, d, "flagged_lineitem"), "l_returnflag")),
    f"SELECT \"column\", round(ratio, 4) AS ratio, CASE WHEN ratio >= 0.5 THEN 'perfect' ELSE 'near' END AS leak, CASE WHEN ratio >= 0.5 THEN 'high' ELSE 'medium' END AS risk FROM ({_PREDICTORS}) WHERE ratio >= 0.2",
)
_TELLING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(sum(n) FILTER (v IS NOT NULL AND k = 1), 0) / sum(n) AS ratio FROM (SELECT {c} AS v, count(DISTINCT l_returnflag) AS k, count(*) AS n FROM {source('telling_lineitem')} GROUP BY 1)"
    for c in ("sure", "hint", "l_linestatus", "order_id", "ship_date")
)
register(
    "predictor_leaks_telling_lineitem",
    lambda s, d: rounded(leakage.predictor_leaks(load(s, d, "telling_lineitem"), "l_returnflag")),
    f"SELECT \"column\", round(ratio, 4) AS ratio, CASE WHEN ratio >= 0.5 THEN 'perfect' ELSE 'near' END AS leak, CASE WHEN ratio >= 0.5 THEN 'high' ELSE 'medium' END AS risk FROM ({_TELLING}) WHERE ratio >= 0.2",
)
_NAMES = ", ".join(f"('{category}', '{name}', '{C.LEAK_RISK[category]}')" for category, names in C.LEAK_NAMES.items() for name in names)
for _t in ("lineitem", "orders", "events", "embeddings"):
    register(
        f"leak_names_{_t}",
        lambda s, d, t=_t: leakage.name_hits_table(load(s, d, t)),
        f"WITH c AS (SELECT column_name AS name, replace(replace(lower(column_name), '_', ''), ' ', '') AS own FROM (DESCRIBE {_t})), p AS (SELECT category, pattern, risk, replace(pattern, '_', '') AS plain FROM (VALUES {_NAMES}) AS v(category, pattern, risk)) "
        "SELECT name AS \"column\", category, pattern, CASE WHEN own = plain THEN 'exact' ELSE 'partial' END AS match, risk FROM c, p WHERE contains(own, plain)",
    )
AS_OF = datetime(1998, 1, 1)
_FUTURE = [("order_date", "order_date"), ("ship_date", "ship_date")]
register(
    "future_dates_dated_lines",
    lambda s, d: leakage.future_dates(load(s, d, "dated_lines"), AS_OF),
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({c} > TIMESTAMP '{AS_OF}') AS DOUBLE) AS future, round(count(*) FILTER ({c} > TIMESTAMP '{AS_OF}') * 100.0 / count(*), 2) AS future_pct FROM {source('dated_lines')}" for c, _ in _FUTURE) + ") WHERE future > 0",
)
register(
    "temporal_order_dated_lines",
    lambda s, d: leakage.temporal_order(load(s, d, "dated_lines")),
    f"SELECT 'order_date' AS early, 'ship_date' AS late, count(*) FILTER (order_date > ship_date) AS violations, count(*) FILTER (order_date IS NOT NULL AND ship_date IS NOT NULL) AS valid, round(count(*) FILTER (order_date > ship_date) * 100.0 / count(*) FILTER (order_date IS NOT NULL AND ship_date IS NOT NULL), 2) AS violation_pct FROM {source('dated_lines')}",
)

# Mutual information.


def _information_sql(name: str, target: str, features: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS x, CAST({target} AS VARCHAR) AS y FROM {source(name)}" for c in features)
    return (
        f"WITH j AS (SELECT feature, x, y, count(*) AS n FROM ({long}) GROUP BY ALL), m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j) "
        "SELECT feature, round(greatest(sum(n / a * ln(n * a / (CAST(nx AS DOUBLE) * ny))), 0.0), 6) AS mi FROM m GROUP BY feature"
    )


for _t, _target, _features in (("dirty_orders", "o_orderstatus", ["priority", "sex"]), ("flagged_lineitem", "l_returnflag", _FLAGGED), ("part", "p_brand", ["p_type"])):
    register(f"mutual_information_{_t}", lambda s, d, t=_t, y=_target, f=_features: rounded(importance.mutual_information(load(s, d, t), y, f), 6), _information_sql(_t, _target, _features))



def _neighbour_sql(name: str, target: str, features: list[str], k: int = 3) -> str:
    """Distances to the k values before and after each in its class, then a count of all values in each ball."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({target} AS VARCHAR) AS y, CAST({c} AS DOUBLE) AS x, row_number() OVER () AS id FROM {source(name)}" for c in features)
    beside = ", ".join(f"abs({f}(x, {j}) OVER w - x)" for j in range(1, k + 1) for f in ("lag", "lead"))
    psi = lambda n: f"(SELECT p FROM psi WHERE psi.n = {n})"
    return (
        f"WITH cells AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size FROM ({long})), kept AS (SELECT * FROM cells WHERE size > 1), "
        f"near AS (SELECT *, list_sort(list_filter([{beside}], lambda d: d IS NOT NULL))[least({k}, size - 1)] AS r FROM kept WINDOW w AS (PARTITION BY feature, y ORDER BY x, id)), "
        "balls AS (SELECT a.feature, a.id, any_value(a.size) AS size, any_value(a.r) AS r, count(*) FILTER (b.y = a.y AND a.r = 0) AS own, greatest(count(*) FILTER (b.x = a.x OR a.r > 0), 1) AS n_all FROM near a JOIN kept b "
        "ON a.feature = b.feature AND (b.x = a.x AND a.r = 0 OR b.x > a.x - a.r AND b.x < a.x + a.r) GROUP BY a.feature, a.id), "
        f"psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM range(1, (SELECT count(*) + 2 FROM cells)) AS t(n)), "
        f"parts AS (SELECT b.feature, o.p - m.p - s.p AS part FROM balls b JOIN psi o ON o.n = CASE WHEN b.r = 0 THEN b.own ELSE least({k}, b.size - 1) END JOIN psi m ON m.n = b.n_all JOIN psi s ON s.n = b.size), "
        "mean AS (SELECT feature, avg(part) AS part, count(*) AS n FROM parts GROUP BY feature) SELECT feature, round(greatest(psi.p + part, 0.0), 6) AS mi FROM mean JOIN psi ON psi.n = mean.n"
    )


for _t, _target, _features in (("part", "p_brand", ["p_retailprice", "p_size"]), ("customer", "c_mktsegment", ["c_acctbal", "c_nationkey"])):
    register(f"neighbour_information_{_t}", lambda s, d, t=_t, y=_target, f=_features: rounded(neighbours.neighbour_information(load(s, d, t), y, f), 6), _neighbour_sql(_t, _target, _features))

register(
    "profile_summary_dirty_lineitem",
    lambda s, d: display.profile_summary(load(s, d, "dirty_lineitem").select(*NUMERIC["dirty_lineitem"])),
    f"SELECT round(avg(outlier_pct), 2) AS mean_outlier_pct, count(*) FILTER (outlier_pct > 5) AS columns_with_outliers FROM ({_outlier_sql('dirty_lineitem', NUMERIC['dirty_lineitem'])})",
)

# Consistency rules.
_TEXTS = CATEGORIES["dirty_orders"]


def values(s: SparkSession, d: str) -> DataFrame:
    return consistency.distinct_values(load(s, d, "dirty_orders"))


_VALUES = f"({counted('dirty_orders', _TEXTS)})"
register("type_classes_dirty_orders", lambda s, d: consistency.type_class_histogram(values(s, d)), f'SELECT "column", {CLASS} AS type_class, CAST(sum(n) AS BIGINT) AS n FROM {_VALUES} GROUP BY ALL')
register(
    "mixed_types_dirty_orders",
    lambda s, d: consistency.mixed_types(values(s, d)),
    f"SELECT *, CASE WHEN semantic_mixing THEN 'high' ELSE 'medium' END AS severity FROM (SELECT \"column\", count(DISTINCT c) AS classes, bool_or(c = 'numeric') AND bool_or(c = 'text_numeric') AS semantic_mixing FROM (SELECT \"column\", {CLASS} AS c FROM {_VALUES}) GROUP BY 1) WHERE classes > 1",
)
register(
    "noise_dirty_orders",
    lambda s, d: consistency.noise(values(s, d)).select("column", "rows", *[F.col(c).cast("long").alias(c) for c in ("null_noise", "placeholder_noise", "encoding_noise")], "noise_pct", "severity"),
    f"SELECT *, CASE WHEN noise_pct > 10 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, round((null_noise + placeholder_noise + encoding_noise) * 100.0 / rows, 2) AS noise_pct FROM (SELECT \"column\", CAST(sum(n) AS BIGINT) AS rows, "
    f"count(DISTINCT CASE WHEN {IS_NULL_NOISE} THEN {NORM} END) AS null_noise, count(DISTINCT CASE WHEN {IS_PLACEHOLDER} THEN {NORM} END) AS placeholder_noise, count(DISTINCT CASE WHEN {IS_ENCODING} THEN value END) AS encoding_noise FROM {_VALUES} GROUP BY 1)) WHERE noise_pct > 0",
)
register(
    "noise_values_dirty_orders",
    lambda s, d: consistency.noise_values(values(s, d)),
    " UNION ALL ".join(f"SELECT \"column\", '{kind}' AS kind, {NORM} AS value, CAST(sum(n) AS BIGINT) AS n FROM {_VALUES} WHERE {test} GROUP BY 1, 3" for kind, test in (("null", IS_NULL_NOISE), ("placeholder", IS_PLACEHOLDER), ("encoding", IS_ENCODING))),
)


def _pattern_sql(patterns: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT \"column\", '{f}' AS family, '{n}' AS pattern, CAST(sum(n) AS BIGINT) AS n FROM {_VALUES} WHERE regexp_matches(value, '{r}') GROUP BY 1" for f, n, r in patterns)


_UNITS = _pattern_sql([(f, p, f"(?i){p}") for f, many in C.UNITS.items() for p in many])
_DATES = _pattern_sql([("date", n, f"^(?:{p})") for n, p in C.DATE_FORMATS.items()])
_PHONES = _pattern_sql([("phone", n, f"^(?:{p})") for n, p in C.PHONE_FORMATS.items()])
register("unit_patterns_dirty_orders", lambda s, d: consistency.unit_patterns(values(s, d)), _UNITS)
register("unit_inconsistencies_dirty_orders", lambda s, d: consistency.unit_inconsistencies(values(s, d)), f'SELECT "column", family, count(*) AS patterns FROM ({_UNITS}) GROUP BY ALL HAVING count(*) > 1')
register("date_formats_dirty_orders", lambda s, d: consistency.date_formats(values(s, d)), _DATES)
register("phone_formats_dirty_orders", lambda s, d: consistency.phone_formats(values(s, d)), _PHONES)
register(
    "format_inconsistencies_dirty_orders",
    lambda s, d: consistency.format_inconsistencies(values(s, d)),
    f"SELECT \"column\", min(family) AS family, arg_min(formats, family) AS formats, CASE WHEN min(family) = 'date' THEN 'medium' ELSE 'low' END AS severity FROM (SELECT \"column\", family, count(*) AS formats FROM ({_DATES} UNION ALL {_PHONES}) GROUP BY ALL HAVING count(*) > 1) GROUP BY 1",
)
register(
    "abbreviation_pairs_dirty_orders",
    lambda s, d: consistency.abbreviation_pairs(values(s, d)),
    " UNION ALL ".join(f"SELECT \"column\", '{a}' AS abbreviation, '{x}' AS expansion FROM {_VALUES} GROUP BY 1 HAVING bool_or({NORM} = '{a}') AND bool_or(contains({NORM}, '{x}') AND {NORM} <> '{a}')" for a, many in C.ABBREVIATIONS.items() for x in many),
)
register("spelling_variants_dirty_orders", lambda s, d: consistency.spelling_variants(values(s, d)), f'SELECT "column", {NORM} AS value, count(*) AS variants FROM {_VALUES} GROUP BY 1, 2 HAVING count(*) > 1')
register(
    "examples_dirty_orders",
    lambda s, d: consistency.examples(load(s, d, "dirty_orders"), "amount", "o_orderkey"),
    f"SELECT kind, value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey, amount AS value, CASE WHEN {IS_NUMERIC.replace('value', 'amount')} THEN 'numeric' ELSE 'text' END AS kind FROM {source('dirty_orders')} WHERE amount IS NOT NULL)) WHERE r <= 2",
)

# Samples.
register(
    "time_thirds_orders",
    lambda s, d: sampling.time_thirds(load(s, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "third"),
    "SELECT o_orderkey, CASE WHEN p < n // 3 THEN 'early' WHEN p >= n - n // 3 THEN 'late' ELSE 'middle' END AS third FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)",
)
register(
    "thirds_sample_orders",
    lambda s, d: sampling.thirds_sample(load(s, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "third"),
    "WITH t AS (SELECT o_orderkey, CASE WHEN p < n // 3 THEN 'early' WHEN p >= n - n // 3 THEN 'late' ELSE 'middle' END AS third FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)) "
    "SELECT o_orderkey, third FROM (SELECT *, row_number() OVER (PARTITION BY third ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS r FROM t) WHERE r <= 3",
)

def _telling_sql(name: str, key: str, texts: list[str], numbers: list[str], columns: list[str], time: str | None = None, parsed: str | None = None) -> str:
    """Every rule's first rows, then quotas, over the whole table."""
    src, rules = source(name), list(telling.RULES)
    draw = lambda seed: f"md5(concat('{seed}:', CAST({key} AS VARCHAR)))"
    missing = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in columns)
    made: list[str] = []

    def rule(kind: str, column: str | None, cell: int, part: str, order: str = "0.0", by: str = "''", table: str = src) -> None:
        severity, quota, k, parts = telling.RULES[kind]
        shown = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
        made.append(
            f"SELECT {rules.index(kind)} AS rule, {cell} AS cell, '{kind}' AS issue_type, {shown} AS \"column\", '{severity}' AS severity, '{quota}' AS quota, part, ord, r, {key}, {parts} AS parts, count(DISTINCT part) OVER () AS found FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY part ORDER BY ord, draw, {key}) AS r FROM (SELECT {key}, {part} AS part, CAST({order} AS DOUBLE) AS ord, {by} AS draw FROM {table}) WHERE part IS NOT NULL) WHERE r <= {k}"
        )

    for i, c in enumerate(texts):
        value = f"trim({c})"
        rule("mixed_types", c, i, f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN {IS_NUMERIC.replace('value', c)} THEN 'numeric' ELSE 'other' END END")
        rule("semantic_nulls", c, i, "CASE WHEN " + " OR ".join(f"contains(lower(coalesce({c}, 'nan')), '{p}')" for p in C.SAMPLE_NULL_PARTS) + " THEN '' END")
        common = f"(SELECT {c} AS v FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 0.5 * (SELECT count({c}) FROM {src}) AND lower(trim({c})) NOT IN ('', 'nan'))"
        rule("dominant_value", c, i, f"CASE WHEN {c} = (SELECT v FROM {common}) THEN '' END")
        rule("date_formats", c, i, "CASE " + " ".join(f"WHEN regexp_matches({value}, '\\d{{1,4}}{x}\\d{{1,2}}{x}\\d{{1,4}}') THEN '{k}'" for x, k in (("/", "slash"), ("-", "dash"), ("\\.", "dot"))) + " END")
        rule("number_formats", c, i, f"CASE WHEN regexp_matches({value}, '[$€£¥]') THEN 'currency' WHEN regexp_matches({value}, '^\\d+\\.?\\d*$') THEN 'plain' WHEN regexp_matches({value}, '\\d+[eE][+-]?\\d+') THEN 'scientific' WHEN contains({value}, '%') AND regexp_matches({value}, '\\d') THEN 'percentage' END")
        rule("blank_text", c, i, f"CASE WHEN {value} = '' THEN '' END")
    rule("many_missing", None, 0, f"CASE WHEN {missing} >= {max(2.0, 0.3 * len(columns))} THEN '' END")
    for i, (a, b) in enumerate(combinations(columns, 2)):
        rule("missing_together", f"{a}, {b}", i, f"CASE WHEN {a} IS NULL AND {b} IS NULL AND (SELECT count(*) FILTER ({a} IS NULL AND {b} IS NULL) * 100.0 > 20 * count(*) FROM {src}) THEN '' END")
    for i, c in enumerate(numbers):
        fences = f"(SELECT *, quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER () AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER () AS q3 FROM {src})"
        low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
        often = f"(SELECT * FROM (SELECT *, count(*) FILTER ({c} < {low} OR {c} > {high}) OVER () * 100.0 / count({c}) OVER () AS pct FROM {fences}) WHERE round(pct, 2) > 5)"
        rule("outlier", c, 2 * i, f"CASE WHEN {c} < {low} THEN 'low' END", c, table=often)
        rule("outlier", c, 2 * i + 1, f"CASE WHEN {c} > {high} THEN 'high' END", f"-{c}", table=often)
    if time:
        at = f"epoch_us({parsed or f'CAST({time} AS TIMESTAMP)'})"
        cuts = f"(SELECT *, quantile_cont({at}::DOUBLE, 1.0::DOUBLE / 3) OVER () AS c1, quantile_cont({at}::DOUBLE, 2.0::DOUBLE / 3) OVER () AS c2 FROM {src} WHERE {at} IS NOT NULL)"
        rule("temporal", time, 0, f"CASE WHEN {at} < c1 THEN 'early' WHEN {at} > c2 THEN 'late' ELSE 'middle' END", by=draw(42), table=cuts)
    else:
        rule("spread", None, 0, "''", by=draw(43))
    rule("baseline", None, 0, "''", missing, draw(42))
    order = "rule, cell, part, r"
    quotas = " ".join(f"WHEN '{q}' THEN {n}" for q, n in sampling.BUDGET.items())
    return (
        f"WITH met AS ({' UNION ALL '.join(made)}), clean AS (SELECT count(*) FILTER (ord = 0) = 5 AS five FROM met WHERE issue_type = 'baseline'), "
        "picked AS (SELECT * FROM met, clean WHERE found >= parts AND (issue_type <> 'baseline' OR five OR r <= 3)), "
        f"once AS (SELECT *, row_number() OVER (PARTITION BY issue_type, \"column\", severity ORDER BY {order}) AS of_mark, row_number() OVER (PARTITION BY issue_type ORDER BY {order}) AS of_type FROM picked), "
        f"kept AS (SELECT *, row_number() OVER (PARTITION BY quota ORDER BY {order}) AS of_quota FROM once WHERE of_mark = 1 OR of_type <= 3) "
        f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, issue_type, \"column\", severity, part, {key} FROM kept WHERE of_quota <= CASE quota {quotas} END"
    )


_DAY_PARSED = "coalesce(try_strptime(day_text, '%Y-%m-%d'), try_strptime(day_text, '%m/%d/%Y'), try_strptime(day_text, '%d-%m-%Y'))"
for _t, _key, _texts, _numbers, _columns, _time in (
    ("dirty_orders", "o_orderkey", CATEGORIES["dirty_orders"], [], ["o_orderkey", *CATEGORIES["dirty_orders"]], "day_text"),
    ("gappy_events", "event_id", ["event_type"], ["value", "reading", "user_id"], ["event_id", "event_type", "value", "reading", "user_id"], None),
    ("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["o_custkey", "o_totalprice"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderdate"),
):
    register(f"telling_rows_{_t}", lambda s, d, t=_t, k=_key: telling.telling_rows(load(s, d, t), k), _telling_sql(_t, _key, _texts, _numbers, _columns, _time, _DAY_PARSED if _time == "day_text" else None))
register("seeded_sample_orders", lambda s, d: sampling.seeded_sample(load(s, d, "orders"), 50, "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY md5(concat('42:', o_orderkey)), o_orderkey LIMIT 50")
register(
    "stride_sample_orders",
    lambda s, d: sampling.stride_sample(load(s, d, "orders"), 40, "o_orderkey").select("o_orderkey"),
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p % greatest(1, n // 40) = 0 AND p < greatest(1, n // 40) * 40",
)
register("baseline_rows_noted_events", lambda s, d: sampling.baseline_rows(load(s, d, "noted_events"), "event_id").select("event_id"), f"SELECT event_id FROM {source('noted_events')} WHERE {_PER_ROW} = 0 ORDER BY md5(concat('42:', event_id)), event_id LIMIT 5")
register("missing_rows_noted_events", lambda s, d: sampling.missing_rows(load(s, d, "noted_events"), 10, "event_id").select("event_id"), f"SELECT event_id FROM {source('noted_events')} WHERE {_PER_ROW} >= 2 ORDER BY event_id LIMIT 10")
register(
    "null_like_rows_dirty_orders",
    lambda s, d: sampling.null_like_rows(load(s, d, "dirty_orders"), "priority", "o_orderkey").select("o_orderkey"),
    f"SELECT o_orderkey FROM {source('dirty_orders')} WHERE " + " OR ".join(f"contains(lower(coalesce(priority, 'nan')), '{p}')" for p in C.SAMPLE_NULL_PARTS) + " ORDER BY o_orderkey LIMIT 3",
)
register(
    "format_rows_dirty_orders",
    lambda s, d: sampling.format_rows(load(s, d, "dirty_orders"), "day_text", "o_orderkey").select("o_orderkey", "format"),
    f"SELECT min(o_orderkey) AS o_orderkey, CASE WHEN contains(day_text, '/') THEN 'slash' ELSE 'dash' END AS format FROM {source('dirty_orders')} WHERE day_text IS NOT NULL GROUP BY 2",
)
register(
    "outlier_rows_dirty_lineitem",
    lambda s, d: sampling.outlier_rows(load(s, d, "dirty_lineitem").select("l_orderkey", "l_quantity"), 0.5, "l_orderkey").withColumn("value", F.round("value", 4)),
    f"SELECT 'l_quantity' AS \"column\", 'low' AS end, min(l_quantity) AS value, arg_min(l_orderkey, struct_pack(v := l_quantity, k := l_orderkey)) AS key FROM {source('dirty_lineitem')} UNION ALL SELECT 'l_quantity', 'high', max(l_quantity), arg_min(l_orderkey, struct_pack(v := -l_quantity, k := l_orderkey)) FROM {source('dirty_lineitem')}",
)

# Claims.
register(
    "semantic_nulls_dirty_orders",
    lambda s, d: validation.semantic_nulls(load(s, d, "dirty_orders")),
    f'SELECT "column", value, n, pct FROM (SELECT "column", value, CAST(n AS BIGINT) AS n, round(n * 100.0 / total, 2) AS pct FROM (SELECT "column", {NORM} AS value, sum(n) AS n, any_value(total) AS total FROM (SELECT v.*, t.total FROM {_VALUES} v JOIN (' + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS total FROM orders" for c in _TEXTS) + f') t ON v."column" = t.c) GROUP BY 1, 2)) WHERE value IN ({quoted(C.CLAIM_NULL_TOKENS)})',
)
_TRIMMED = f"(SELECT trim(CAST({{c}} AS VARCHAR)) AS value FROM {source('dirty_orders')} WHERE {{c}} IS NOT NULL)"
register(
    "date_kinds_dirty_orders",
    lambda s, d: validation.date_kinds(load(s, d, "dirty_orders"), "day_text", "o_orderkey"),
    f"SELECT * FROM (SELECT CASE WHEN contains(value, '/') THEN 'slash' WHEN contains(value, '-') THEN 'dash' WHEN contains(value, '.') THEN 'dot' END AS kind, count(*) AS n FROM {_TRIMMED.format(c='day_text')} WHERE length(value) > 5 AND regexp_matches(value, '\\d') GROUP BY 1) WHERE kind IS NOT NULL",
)
register(
    "number_kinds_dirty_orders",
    lambda s, d: validation.number_kinds(load(s, d, "dirty_orders"), "amount", "o_orderkey"),
    f"SELECT * FROM (SELECT CASE WHEN regexp_matches(value, '[$€£¥]') THEN 'currency' WHEN regexp_matches(value, '^\\d+\\.?\\d*$') THEN 'plain' WHEN regexp_matches(value, '\\d+[eE][+-]?\\d+') THEN 'scientific' WHEN contains(value, '%') AND regexp_matches(value, '\\d') THEN 'percentage' END AS kind, count(*) AS n FROM {_TRIMMED.format(c='amount')} GROUP BY 1) WHERE kind IS NOT NULL",
)
_WORDS = " OR ".join(f"contains({NORM}, '{w}')" for w in C.NUMBER_WORDS)
register(
    "mixed_shares_dirty_orders",
    lambda s, d: rounded(validation.mixed_shares(load(s, d, "dirty_orders"), "amount", "o_orderkey")),
    f"SELECT round(count(*) FILTER ({IS_NUMERIC}) / count(*), 4) AS numeric, round(count(*) FILTER (NOT {IS_NUMERIC} AND ({_WORDS})) / count(*), 4) AS number_words, round(count(*) FILTER (NOT {IS_NUMERIC} AND NOT ({_WORDS})) / count(*), 4) AS other FROM {_TRIMMED.format(c='amount')}",
)
# Under these names too, which other twins read.
for _name, _make in {
    "date_kinds": lambda s, d: validation.date_kinds(load(s, d, "dirty_orders"), "day_text", "o_orderkey"),
    "number_kinds": lambda s, d: validation.number_kinds(load(s, d, "dirty_orders"), "amount", "o_orderkey"),
    "mixed_shares": lambda s, d: rounded(validation.mixed_shares(load(s, d, "dirty_orders"), "amount", "o_orderkey")),
}.items():
    register(f"{_name}_dirty_orders_whole", _make, REGISTRY[f"{_name}_dirty_orders"][1])
CLAIMS = [
    {"issue_type": "mixed_data_types", "affected_columns": ["amount"]},
    {"issue_type": "semantic_nulls", "affected_columns": ["priority"]},
    {"issue_type": "semantic_nulls", "affected_columns": ["sex"]},
    {"issue_type": "inconsistent_formats", "affected_columns": ["day_text"]},
    {"issue_type": "inconsistent_formats", "affected_columns": ["sex"]},
    {"issue_type": "missing_values", "affected_columns": ["priority"]},
    {"issue_type": "outliers", "affected_columns": ["o_orderkey"]},
    {"issue_type": "duplicates", "affected_columns": []},
    {"issue_type": "correlation", "affected_columns": ["o_orderkey"]},
    {"issue_type": "something_else", "affected_columns": ["sex"]},
]
def _claims(s: SparkSession, d: str) -> DataFrame:
    found = validation.validate(load(s, d, "dirty_orders"), CLAIMS, "o_orderkey")["claims"]
    return s.createDataFrame([(i, c["issue_type"], c["validation_status"]) for i, c in enumerate(found)], "claim long, issue_type string, validation_status string")


def _evidence_claims(name: str, claims: list[tuple[str, tuple[str, ...]]]) -> tuple[Callable, str]:
    """A query of claims with their evidence, and the same from the table in SQL."""
    src = source(name)

    def one(i: int, kind: str, columns: tuple[str, ...]) -> str:
        mean = lambda each: f"(SELECT avg(x) FROM ({' UNION ALL '.join(each)}))"
        if kind == "missing_values":
            value = mean([f"SELECT round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS x FROM {src}" for c in columns])
        elif kind == "outliers":
            value = mean([f"SELECT outlier_pct AS x FROM ({_outlier_sql(name, [c])})" for c in columns])
        elif kind == "duplicates":
            value = f"(SELECT sum(n) - count(*) FROM (SELECT count(*) AS n FROM (SELECT hash(t) AS h, t FROM (SELECT * FROM {src}) AS t) GROUP BY t))"
        elif kind == "correlation":
            value = f"(SELECT count(*) FROM ({_pairs_sql(name, list(columns))}) WHERE abs(r) > 0.7)"
        elif kind == "semantic_nulls":
            value = "(" + " + ".join(f"(EXISTS (SELECT 1 FROM {src} WHERE lower(trim({c})) IN ({quoted(C.CLAIM_NULL_TOKENS)})))::INTEGER" for c in columns) + ")"
        else:
            number = lambda c: IS_NUMERIC.replace("value", c)
            words = lambda c: "(" + " OR ".join(f"contains(lower(trim({c})), '{w}')" for w in C.NUMBER_WORDS) + ")"
            value = "(" + " + ".join(f"(SELECT coalesce(avg({number(c)}::INTEGER) > 0.05 AND greatest(avg((NOT {number(c)} AND {words(c)})::INTEGER), avg((NOT {number(c)} AND NOT {words(c)})::INTEGER)) > 0.05, false) FROM {src} WHERE {c} IS NOT NULL)::INTEGER" for c in columns) + ")"
        holds = "e IS NOT NULL" if kind in ("missing_values", "outliers") else "e > 0"
        return f"SELECT CAST({i} AS BIGINT) AS claim, '{kind}' AS issue_type, CASE WHEN {holds} THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS validation_status, round(e, 4) AS evidence FROM (SELECT CAST({value} AS DOUBLE) AS e)"

    asked = [{"issue_type": k, "affected_columns": list(c)} for k, c in claims]
    return lambda s, d: rounded(validation.claim_evidence(load(s, d, name), asked)), " UNION ALL ".join(one(i, k, c) for i, (k, c) in enumerate(claims))


for _t, _asked in {
    "dirty_lineitem": [("missing_values", ("l_discount", "l_tax")), ("outliers", ("l_quantity", "l_extendedprice")), ("duplicates", ()), ("correlation", ("l_quantity", "l_extendedprice")), ("mixed_types", ("l_returnflag", "l_linestatus")), ("missing_values", ("l_linestatus",))],
    "leaky_lineitem": [("correlation", ("l_quantity", "twin", "close", "fixed")), ("correlation", ("l_discount", "twin")), ("outliers", ("fixed",)), ("duplicates", ())],
    "dirty_orders": [("mixed_types", ("amount", "sex", "phone")), ("semantic_nulls", ("priority", "amount", "sex")), ("missing_values", ("priority", "day_text"))],
    "dup_orders": [("duplicates", ()), ("semantic_nulls", ("o_orderpriority",))],
}.items():
    register(f"claim_evidence_{_t}", *_evidence_claims(_t, _asked))


# Scores. The operators are functions on the driver; the twins work the same grids out in SQL.
register(
    "blend_grid",
    lambda s, d: s.createDataFrame([(float(a), float(b), c, r, scoring.blend(a, b, scoring.blend_weight(c, r))) for a in (0, 35, 62, 90) for b in (0, 40, 70, 100) for c in ("HIGH", "MEDIUM", "LOW", "NONE") for r in ("HIGH", "MEDIUM", "LOW")], "own double, other double, confidence string, reliability string, blended double"),
    "SELECT own, other, confidence, reliability, round(least(100, greatest(0, own + w * least(15, greatest(-15, other - own)))), 2) AS blended FROM (SELECT *, least(0.45, greatest(0.05, CASE confidence WHEN 'HIGH' THEN 0.35 WHEN 'MEDIUM' THEN 0.25 WHEN 'LOW' THEN 0.15 ELSE 0.2 END + CASE reliability WHEN 'HIGH' THEN 0.1 WHEN 'LOW' THEN -0.15 ELSE 0 END))::DOUBLE AS w "
    "FROM (SELECT unnest([0, 35, 62, 90])::DOUBLE AS own), (SELECT unnest([0, 40, 70, 100])::DOUBLE AS other), (SELECT unnest(['HIGH', 'MEDIUM', 'LOW', 'NONE']) AS confidence), (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS reliability))",
)
_ROWS, _COLS = [0, 50, 99, 100, 499, 500, 5000, 100_000], [1, 2, 11, 51, 301]
register(
    "quantity_grid",
    lambda s, d: s.createDataFrame([(n, c, i, scoring.quantity(scoring.Evidence(rows=n, columns=c, balanced=i <= 1, imbalance=float(i)))) for n in _ROWS for c in _COLS for i in (1, 6, 11, 21)], "n long, c long, i long, score double"),
    "SELECT n, c, i, CAST(least(100, greatest(0, base - CASE WHEN n < 100 THEN 20 WHEN n < 500 THEN 10 ELSE 0 END - CASE WHEN i > 20 THEN 15 WHEN i > 10 THEN 10 WHEN i > 5 THEN 5 ELSE 0 END - CASE WHEN spf < 10 THEN 15 WHEN spf < 20 THEN 8 ELSE 0 END)) AS DOUBLE) AS score FROM (SELECT *, CASE WHEN spf >= 100 THEN 95 WHEN spf >= 50 THEN 82 WHEN spf >= 20 THEN 65 WHEN spf >= 10 THEN 45 ELSE 25 END AS base FROM (SELECT *, n / greatest(1, c - 1) AS spf "
    f"FROM (SELECT unnest({_ROWS})::BIGINT AS n), (SELECT unnest({_COLS})::BIGINT AS c), (SELECT unnest([1, 6, 11, 21])::BIGINT AS i)))",
)
register(
    "completeness_grid",
    lambda s, d: s.createDataFrame([(float(m), k, float(p), scoring.completeness(scoring.Evidence(rows=10, missing_pct=m, missing_by_column={str(j): 41.0 for j in range(k)}, duplicate_pct=p))) for m in (0, 3, 19, 21, 80) for k in (0, 1, 7) for p in (0, 4, 14, 90)], "m double, k long, p double, score double"),
    "SELECT m, k, p, greatest(0, 100 - least(2 * m, 40) - 5 * k - least(1.5 * p, 20))::DOUBLE AS score FROM (SELECT unnest([0, 3, 19, 21, 80])::DOUBLE AS m), (SELECT unnest([0, 1, 7])::BIGINT AS k), (SELECT unnest([0, 4, 14, 90])::DOUBLE AS p)",
)


def _grid_issue(kind: str, severity: str, n: int) -> dict:
    return {"issue_type": kind, "severity": severity, "affected_columns": ["c"] * n, "validation_status": "VERIFIED"}


register(
    "penalty_grid",
    lambda s, d: rounded(s.createDataFrame([(k, v, n, scoring.issue_penalty(_grid_issue(k, v, n))) for k in C.IMPACT for v in C.SEVERITY for n in (1, 2, 5, 9)], "issue_type string, severity string, n long, penalty double"), 6),
    "SELECT issue_type, severity, n, round(w * f * least(1 + (n - 1) * 0.2, 2.0) * 20, 6)::DOUBLE AS penalty FROM (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in C.IMPACT.items()) + ") AS a(issue_type, w), (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in C.SEVERITY.items()) + ") AS b(severity, f), (SELECT unnest([1, 2, 5, 9])::BIGINT AS n)",
)
register(
    "grades",
    lambda s, d: s.createDataFrame([(x / 2, scoring.grade(x / 2)) for x in range(201)], "score double, grade string"),
    "SELECT i / 2 AS score, CASE WHEN i >= 180 THEN 'A' WHEN i >= 160 THEN 'B' WHEN i >= 140 THEN 'C' WHEN i >= 120 THEN 'D' ELSE 'F' END AS grade FROM range(201) AS r(i)",
)
register(
    "supported_models",
    lambda s, d: s.createDataFrame([("classification", m[0]) for m in C.CLASSIFIERS] + [("regression", m[0]) for m in C.REGRESSORS], "problem string, model string"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m[0]}')" for p, many in (("classification", C.CLASSIFIERS), ("regression", C.REGRESSORS)) for m in many) + ") AS t(problem, model)",
)

# Answers as text.
ANSWERS = ['{"score": 7, "note": "cut', "The score is about 62 of 100.", '{"score": 70, "note": "a"}', 'Sure: ```json\n{"score": 60, "note": "b"}\n```', 'text {"score": 50, "note": "c"} text', '{"score": 40, "note": "d",}', "no json at all", ""]


def _answers(s: SparkSession, d: str) -> DataFrame:
    df = s.createDataFrame(list(enumerate(ANSWERS)), "answer long, text string")
    return assess.parse_answers(df, "text", "score long, note string").select("answer", "strategy", F.col("parsed.score").alias("score"), F.col("parsed.note").alias("note"))


register(
    "parsed_answers",
    _answers,
    "SELECT answer, strategy, CASE strategy WHEN 'direct' THEN CAST(json_extract_string(text, '$.score') AS BIGINT) WHEN 'prose' THEN CAST(nullif(regexp_extract(text, '(?i)\\bscore\\b[^0-9{}]*?(-?[0-9]+)', 1), '') AS BIGINT) ELSE CAST(nullif(regexp_extract(text, '\"score\": ([0-9]+)', 1), '') AS BIGINT) END AS score, "
    "CASE WHEN strategy IN ('direct', 'fenced', 'braces', 'mended') THEN regexp_extract(text, '\"note\": \"([a-z]+)\"', 1) END AS note FROM (SELECT answer, text, CASE WHEN json_valid(text) AND NOT contains(text, ',}') THEN 'direct' WHEN contains(text, '```') THEN 'fenced' WHEN json_valid(regexp_extract(text, '\\{.*\\}')) AND NOT contains(text, ',}') THEN 'braces' "
    "WHEN json_valid(replace(regexp_extract(text, '\\{.*\\}'), ',}', '}')) THEN 'mended' WHEN regexp_matches(text, '\"score\": [0-9]') THEN 'partial' WHEN regexp_matches(text, 'score [a-z ]*[0-9]') THEN 'prose' END AS strategy FROM (VALUES "
    + ", ".join(f"({i}::BIGINT, " + "concat(" + ", ".join(("chr(10)" if part == "\n" else "'" + part.replace("'", "''") + "'") for part in re.split("(\n)", text)) + ")" + ")" for i, text in enumerate(ANSWERS))
    + ") AS t(answer, text))",
)

# Streams.
register(
    "windowed_profile_events",
    lambda s, d: rounded(streaming.windowed_profile(load(s, d, "events"), "ts", ["value"], "1 day")),
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, 'value' AS \"column\", count(*) AS n, count(*) FILTER (value IS NULL) AS missing, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY 1",
)


def _running(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream, profiled batch by batch and merged."""
    base = f"{shared_dir(s)}/running-{datetime.now():%H%M%S%f}"
    stream = s.readStream.schema(load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    streaming.running_profile(stream, ["value", "user_id"], f"{base}/partial", f"{base}/checkpoint").awaitTermination()
    return rounded(streaming.merged(s.read.parquet(f"{base}/partial")), 2)


register(
    "running_profile_events",
    _running,
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c})::DOUBLE, 2) AS min, round(max({c})::DOUBLE, 2) AS max FROM events" for c in ("value", "user_id")),
)


# Without a twin: models, and reports made of everything above.
def _signal(s: SparkSession, d: str) -> DataFrame:
    lines = load(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_returnflag")
    found = baseline.train(lines, "l_returnflag", "classification")
    return s.createDataFrame([(found.metric, round(found.value, 2), found.quality, found.score())], "metric string, value double, quality string, points int")


register("rf_signal_lineitem", _signal)
register("report_labels", lambda s, d: report.as_table(s, report.analyze(load(s, d, "labels"), "toxic", name="labels", as_of=AS_OF)))
register("report_dirty_orders", lambda s, d: report.as_table(s, report.analyze(load(s, d, "dirty_orders"), "o_orderstatus", name="dirty_orders", as_of=AS_OF)))


def _evidence() -> None:
    from dqengine import evidence_queries  # it reads this module's twins

    if "scores_customer" not in REGISTRY:
        evidence_queries.register_all(register)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _evidence()
    return {name: make for name, (make, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _evidence()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
