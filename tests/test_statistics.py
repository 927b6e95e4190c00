"""Order statistics, pairs of many columns and other statistics of whole tables, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqengine.functions import catalogs, exprs
from dqengine.operators import baseline, profile, quantiles, sampling


def plan_of(df):
    return df._jdf.queryExecution().toString()


COLUMNS = {
    "uniform": lambda r, n: r.random(n),
    "ties": lambda r, n: r.integers(0, 3, n).astype(float),
    "constant": lambda r, n: np.full(n, -2.5),
    "wide": lambda r, n: np.where(r.random(n) < 0.5, -1, 1) * 10.0 ** r.integers(-300, 300, n),
    "close": lambda r, n: 1e15 + r.integers(0, 40, n),
    "gaps": lambda r, n: np.where(r.random(n) < 0.4, np.nan, r.normal(size=n)),
    "ends": lambda r, n: np.where(r.random(n) < 0.1, np.inf, np.where(r.random(n) < 0.1, -np.inf, r.normal(size=n))),
    "signs": lambda r, n: np.where(r.random(n) < 0.5, 0.0, -0.0),
    "tiny": lambda r, n: r.integers(-5, 5, n) * 5e-324,
}


@pytest.mark.parametrize("n, few, even", [(1, 50_000, 8192), (2, 0, 8192), (997, 50_000, 8192), (998, 3, 4), (4000, 0, 64)])
def test_quartiles_are_exact(spark, monkeypatch, n, few, even):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "EVEN", even)
    monkeypatch.setattr(quantiles, "AT_ONCE", 7)
    rng = np.random.default_rng(n)
    data = {c: made(rng, n) for c, made in COLUMNS.items()}
    df = spark.createDataFrame([tuple(float(v[i]) for v in data.values()) for i in range(n)], ", ".join(f"{c} double" for c in data)).repartition(3)
    found = quantiles.order_statistics(df, list(data), (0.0, 0.25, 0.5, 0.75, 0.9, 1.0))
    for c, v in data.items():
        v = np.sort(v[~np.isnan(v)])
        if not len(v):
            assert c not in found
            continue
        for p, got in zip((0.0, 0.25, 0.5, 0.75, 0.9, 1.0), found[c]):
            low, part = int(p * (len(v) - 1)), p * (len(v) - 1) % 1
            a, b = v[low], v[min(low + 1, len(v) - 1)] if part else v[low]
            assert got == (a if a == b else a + (b - a) * part) or np.isclose(got, a + (b - a) * part, rtol=1e-15), (c, p)


def test_no_percentile_buffer_in_plans_of_a_table(spark):
    df = spark.range(1000).selectExpr("id * 1.5 as a", "cast(id % 7 as int) as b", "cast(null as double) as c", "'x' as d")
    for made in (profile.numeric_summary(df), profile.outliers(df)):
        assert "percentile" not in plan_of(made)
    assert [(r["column"], r.q25, r.q50, r.q75) for r in profile.numeric_summary(df).collect()] == [("a", 374.625, 749.25, 1123.875), ("b", 1.0, 3.0, 5.0)]
    assert profile.outlier_bounds(df) == [("a", -749.25, 2247.75), ("b", -5.0, 11.0)]


def test_correlations_of_a_thousand_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 1000))
    base[:, 1] = base[:, 0] * -2 + 5
    base[:, 2] = 4.2
    base[rng.random(base.shape) < 0.05] = np.nan
    base[:, 3] = np.where(np.isnan(base[:, 0]), base[:, 3], 7.0)  # constant where the first is
    names = [f"c{i}" for i in range(1000)]
    df = spark.createDataFrame([([float(x) for x in row],) for row in base], "v array<double>").select(*[f"v[{i}] as c{i}" for i in ()], "v")

    df = df.select(*[F.col("v")[i].alias(c) for i, c in enumerate(names)]).repartition(3)
    found = {(r.column_a, r.column_b): r.r for r in profile.correlations(df).collect()}
    assert len(found) == 1000 * 999 // 2
    for i, j in [(0, 1), (0, 2), (0, 3), (4, 999), *rng.integers(4, 1000, (300, 2)).tolist()]:
        if i == j:
            continue
        i, j = min(i, j), max(i, j)
        both = ~np.isnan(base[:, i]) & ~np.isnan(base[:, j])
        x, y = base[both, i], base[both, j]
        want = None if len(set(x)) == 1 or len(set(y)) == 1 else np.corrcoef(x, y)[0, 1]
        got = found[f"c{i}", f"c{j}"]
        assert got is None if want is None else abs(got - want) < 1e-12, (i, j)
    met = {(r.column_a, r.column_b): r.both_missing for r in profile.co_missing(df).collect()}
    gone = np.isnan(base).astype(int)
    want = gone.T @ gone
    assert met == {(f"c{i}", f"c{j}"): want[i, j] for i in range(1000) for j in range(i + 1, 1000) if want[i, j]}


def test_pairs_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b int, c string")
    assert profile.correlations(empty).collect() == [] or all(r.r is None for r in profile.correlations(empty).collect())
    assert profile.co_missing(empty).collect() == [] and profile.co_missing(empty.select("a")).collect() == []
    one = spark.createDataFrame([(1.0, None, None), (2.0, None, None), (float("inf"), 3, "x")], "a double, b int, c string")
    assert [(r.column_a, r.column_b, r.both_missing) for r in profile.co_missing(one).collect()] == [("b", "c", 2)]
    assert [r.r for r in profile.correlations(one).collect()] == [None]
    assert [(r.column_a, r.column_b) for r in profile.co_missing(one, 70.0).collect()] == []


def slow_information(label, x, k=3):
    """By definition, one value at a time."""
    import collections
    import math

    size = collections.Counter(label)
    rows = [(a, b) for a, b in zip(label, x) if size[a] > 1]
    psi = lambda n: -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))
    total = 0.0
    for i, (a, b) in enumerate(rows):
        r = sorted(abs(d - b) for j, (c, d) in enumerate(rows) if c == a and j != i)[min(k, size[a] - 1) - 1]
        inside = [c for c, d in rows if (b - r < d < b + r if r else d == b)]
        total += psi(sum(c == a for c in inside) if not r else min(k, size[a] - 1)) - psi(max(1, len(inside))) - psi(size[a])
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else None


@pytest.mark.parametrize("block", [4, 8192])
def test_neighbour_information(spark, block):
    from dqengine.operators.neighbours import neighbour_information

    rng = np.random.default_rng(9)
    n = 160
    label = [["a", "b", "c"][i] for i in rng.integers(0, 3, n)] + ["alone"]
    far = [float(ord(c[0]) + rng.normal() * 0.3) for c in label]
    noise, whole, few = rng.random(n + 1).tolist(), rng.integers(0, 40, n + 1).tolist(), rng.integers(0, 3, n + 1).tolist()
    text = [c if i % 5 else "a" for i, c in enumerate(label)]
    df = spark.createDataFrame(list(zip(label, far, noise, whole, few, text)), "y string, far double, noise double, whole int, few long, text string").repartition(3)
    found = {r.feature: r.mi for r in neighbour_information(df, "y", block=block).collect()}
    for name, x in (("far", far), ("noise", noise), ("whole", whole), ("few", few)):
        assert abs(found[name] - slow_information(label, x)) < 1e-9, name
    assert found["far"] > 0.5 > 0.2 > found["noise"] and found["text"] > 0.4
    other = {r.feature: r.mi for r in neighbour_information(df, "far", ["y", "noise"], block=block).collect()}
    assert abs(other["y"] - found["far"]) < 1e-9 and set(other) == {"y", "noise"}


def test_neighbour_information_of_odd_columns(spark):
    from dqengine.operators.neighbours import neighbour_information

    rows = [("a", 1.0, None), ("a", None, None), (None, 2.0, None), ("b", float("inf"), None), ("b", float("nan"), None), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "y string, x double, z int")
    found = {r.feature: r.mi for r in neighbour_information(df, "y").collect()}
    filled = [1.0, 1.0, 2.0, 1.7976931348623157e308, 1.0, 1.0]  # the median of 1, 1, 2 and infinity is 1.5
    filled[1] = filled[4] = 1.5
    assert set(found) == {"x"} and abs(found["x"] - slow_information(["a", "a", "a", "b", "b", "a"], filled)) < 1e-9
    assert neighbour_information(df.limit(0), "y").collect() == []


def test_sketches_of_parts_are_those_of_the_whole(spark):
    from dqengine.operators import sketches

    rng = np.random.default_rng(12)
    n = 60_000
    zipf = np.minimum(rng.zipf(1.5, n), 10_000)
    x = rng.normal(1e6, 3, n)
    rows = [(float(x[i]) if i % 10 else None, int(zipf[i]), f"id{i}", "v" * 300 + str(zipf[i] % 3) if i % 4 else None, float("nan")) for i in range(n)]
    df = spark.createDataFrame(rows, "x double, z int, id string, long string, none double").repartition(5)
    half = [sketches.sketch(df.where(F.xxhash64("id") % 2 == r)) for r in (0, 1, -1)]
    path = f"{__import__('tempfile').mkdtemp()}/states"
    for part in half:
        part.write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 15
    whole = {r["column"]: r for r in sketches.read(sketches.sketch(df)).collect()}
    parts = {r["column"]: r for r in sketches.read(sketches.merged(spark.read.parquet(path))).collect()}
    true = {r["column"]: r for r in profile.numeric_summary(df).collect()}
    assert set(whole) == set(parts) == {"x", "z", "id", "long", "none"}
    for found in (whole, parts):
        assert [(c, found[c].rows, found[c].missing) for c in ("x", "z", "long", "none")] == [("x", n, n // 10), ("z", n, 0), ("long", n, n // 4), ("none", n, n)]
        for c, exact in (("id", n), ("z", len(set(zipf.tolist()))), ("long", 3), ("x", n - n // 10)):
            assert abs(found[c].n_unique - exact) <= sketches.DISTINCT_ERROR * exact, c
        for c in ("x", "z"):
            values = np.sort(np.array([v for v in (x[np.arange(n) % 10 > 0] if c == "x" else zipf)], float))
            for p, got in ((0.25, found[c].q25), (0.5, found[c].q50), (0.75, found[c].q75)):
                low, high = np.searchsorted(values, got, "left") / len(values), np.searchsorted(values, got, "right") / len(values)
                assert low - sketches.RANK_ERROR <= p <= high + sketches.RANK_ERROR, (c, p)
            for m in ("mean", "std", "min", "max", "skewness", "kurtosis"):
                assert np.isclose(found[c][m], true[c][m], rtol=1e-6, atol=1e-6), (c, m)
        often = np.bincount(zipf)
        assert [int(t.value) for t in found["z"].top] == [1, 2, 3] and all(abs(t.n - often[int(t.value)]) <= sketches.COUNT_ERROR * n for t in found["z"].top)
        assert found["none"].mean is None and found["none"].top == [] and found["none"].q50 is None
    sizes = sketches.merged(spark.read.parquet(path)).select(F.octet_length("distinct") + F.octet_length("cuts") + F.octet_length("items.sketch")).collect()
    assert max(r[0] or 0 for r in sizes) < 400_000


def test_sketches_of_an_empty_table(spark):
    from dqengine.operators import sketches

    empty = spark.createDataFrame([], "a int, b string, c array<int>")
    assert [(r["column"], r.rows, r.n_unique, r.q50, r.top) for r in sketches.read(sketches.merged(sketches.sketch(empty))).orderBy("column").collect()] == [(c, 0, 0, None, []) for c in "abc"]


def test_lenient_report_reads_sketches(spark):
    from dqengine.plans.report import analyze

    rows = [(i % 50, float(i % 7), f"t{i % 60}", None if i % 3 else "a", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, x double, many string, gaps string, y int").repartition(3)
    exact, sketched = (analyze(df, target="y", with_model=False, exact=e) for e in (True, False))
    assert sketched["quality_score"]["overall"] == exact["quality_score"]["overall"]
    for part in ("missing", "categorical_features", "numeric_features"):
        assert set(sketched["data_profile"][part]) == set(exact["data_profile"][part])
    assert sketched["data_profile"]["missing"] == exact["data_profile"]["missing"] and sketched["data_profile"]["categorical_features"]["gaps"]["mode"] == "a"


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_claims_and_samples_take_a_fixed_number_of_jobs(spark):
    from dqengine.operators import telling, validation

    df = spark.range(400).selectExpr("id", *[f"CASE WHEN id % {i + 2} = 0 THEN 'n/a' ELSE concat('t', id % {i + 7}) END AS c{i}" for i in range(9)], "id % 13 * 1.0 AS x", "id % 5 * 2.0 AS y").coalesce(2)
    claims = [{"issue_type": k, "affected_columns": [c]} for c in ("c0", "c1", "c2", "x", "y") for k in ("mixed", "semantic_null", "format", "missing", "outlier", "correlation", "duplicate")]
    claims += [{"issue_type": "correlation", "affected_columns": ["x", "y"]}, {"issue_type": "odd", "affected_columns": ["gone"]}, {"issue_type": "missing"}]
    few = [next(c for c in claims if c["issue_type"] == k and c["affected_columns"] in (["c0"], ["x"]) ) for k in ("mixed", "semantic_null", "format", "missing", "duplicate")] + [claims[21 + 4], claims[-3]]
    assert jobs_of(spark, lambda: validation.validate(df, claims)) <= jobs_of(spark, lambda: validation.validate(df, few)) + 2
    found = validation.validate(df, claims)["claims"]
    assert [c["validation_status"] for c in found[-3:]] == ["UNVERIFIED", "UNVERIFIED", "UNVERIFIED"] and found[0]["evidence"] == 0.0
    assert jobs_of(spark, lambda: telling.samples(df, "id")) <= jobs_of(spark, lambda: telling.samples(df.select("id", "c0", "x"), "id")) + 2


def test_samples_of_odd_tables(spark):
    from dqengine.operators import telling

    empty = spark.createDataFrame([], "id long, s string, x double")
    assert telling.samples(empty, "id") == []
    rows = [(i, None if i % 2 else " ", None if i % 2 else float(i)) for i in range(12)]
    found = telling.samples(spark.createDataFrame(rows, "id long, s string, x double"), "id")
    kinds = {r["issue_type"] for r in found}
    assert {"blank_text", "many_missing", "missing_together", "semantic_nulls", "spread", "baseline"} <= kinds and len(found) <= 50
    assert [r["row"]["id"] for r in found if r["issue_type"] == "missing_together"] == [1]
    assert all(r["severity"] != "MEDIUM" for r in telling.samples(spark.createDataFrame(rows, "id long, s string, x double"), "id", compat=True))


def test_report_of_batches_is_that_of_the_whole(spark):
    from datetime import datetime
    from tempfile import mkdtemp

    from dqengine.plans import growing, report

    rng = np.random.default_rng(21)
    base = rng.normal(1e6, 3, 4000)
    rows = [(i % 1500, float(x), float(2 * x + rng.normal()) if i % 9 else None, 7, float(rng.exponential()), None if i % 4 == 0 else f"t{i % 60}", "ab"[i % 2]) for i, x in enumerate(base)]
    rows += rows[:1000]
    df = spark.createDataFrame(rows, "k int, x double, y double, same int, tail double, many string, two string").repartition(4).persist()
    folder = f"{mkdtemp()}/states"
    part = lambda r: df.where(F.pmod(F.xxhash64("k", "x"), F.lit(4)) == r)
    growing.add(part(0), folder, 0)
    first = growing.evidence(spark, folder)
    assert first.rows == part(0).count()
    growing.add(part(3), folder, 1)  # run again below with what belongs there
    for r in (1, 2, 3):
        growing.add(part(r).select(*(reversed(df.columns) if r == 2 else df.columns)), folder, r)
    growing.add(df.limit(0), folder, 4)
    found = growing.evidence(spark, folder)
    want = report.gather(df, None, None, datetime(2024, 1, 1), parts=report.PARTS - {"consistency", "target"})
    assert (found.rows, found.columns, found.missing_by_column, found.missing_pct, found.binary, found.low_variance, found.high_cardinality) == (5000, 7, want.missing_by_column, want.missing_pct, want.binary, want.low_variance, want.high_cardinality)
    assert found.high_pairs == want.high_pairs == 1 and abs(found.max_abs_r - want.max_abs_r) < 1e-6 and abs(found.duplicate_pct - want.duplicate_pct) < 4
    assert set(found.outlier_pct) == set(want.outlier_pct) and all(abs(p - want.outlier_pct[c]) < 1 for c, p in found.outlier_pct.items())
    assert found.outlier_pct["same"] == 0 and found.outlier_pct["tail"] > 2
    for c, v in want.details["numeric_features"].items():
        assert found.details["numeric_features"][c]["variance"] == pytest.approx(v["variance"], rel=1e-6, abs=1e-9)
    assert found.details["categorical_features"]["two"]["mode_count"] == want.details["categorical_features"]["two"]["mode_count"]
    told = growing.report(spark, folder)
    assert told["not_covered"] == ["consistency", "target"] and told["rows"] == 5000
    assert {i["title"] for i in told["detected_issues"]} and told["quality_score"]["breakdown"]["data_completeness"]["score"] == pytest.approx(report.scoring.completeness(want), abs=6)


def test_report_follows_a_stream(spark):
    from tempfile import mkdtemp

    from dqengine.plans import growing

    here = mkdtemp()
    df = spark.createDataFrame([(i, float(i % 5), None if i % 2 else "a") for i in range(300)], "i long, x double, t string")
    for k in range(2):
        df.where(F.col("i") % 2 == k).write.mode("append").parquet(f"{here}/table")
        growing.follow(spark.readStream.schema(df.schema).parquet(f"{here}/table"), f"{here}/states", f"{here}/checkpoint").awaitTermination()
        e = growing.evidence(spark, f"{here}/states")
        assert (e.rows, e.missing_by_column) == ((150, {}) if k == 0 else (300, {"t": 50.0}))
    alone = spark.createDataFrame([("a",), (None,)], "t string")
    growing.add(alone, f"{here}/alone", 0)
    assert growing.evidence(spark, f"{here}/alone").missing_by_column == {"t": 50.0}


def test_no_task_of_the_forest_gets_a_whole_class(spark):
    df = spark.range(6000).selectExpr("IF(id % 10 = 0, 'rare', 'often') AS _target", "CAST(id % 7 AS DOUBLE) AS f0")
    table = baseline.dealt(df, ["f0"], "_target", 3, 6000, 2).persist()
    rows = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 4 and max(rows) < 2 * 6000 / len(rows)
    folds = table.groupBy("_target").pivot("_fold", [0, 1, 2]).count().collect()
    assert {r["_target"]: (r["0"], r["1"], r["2"]) for r in folds} == {"rare": (200,) * 3, "often": (1800,) * 3}
    table.unpersist()


def test_the_forest_keeps_nothing(spark):
    df = spark.range(60).selectExpr("IF(id % 2 = 0, 'a', 'b') AS t", "CAST(id % 7 AS DOUBLE) AS x")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    baseline.train(df, "t", "classification")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_dates_are_told_by_distinct_values(spark, monkeypatch):
    """Texts are parsed as dates once a value, not once a row; a text between dates that is none counts."""
    seen, parse = spark.sparkContext.accumulator(0), profile.E.parse_date

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(profile.E, "parse_date", lambda c: parse(counted(c)))
    day = "concat('2020-01-0', id % 9 + 1)"
    df = spark.range(4000).selectExpr(f"{day} AS dates", f"IF(id % 5 = 2, 'soon', {day}) AS last", f"IF(id = 70, '2020-01-02x', {day}) AS between", "CAST(NULL AS STRING) AS none")
    assert profile.column_classes(df) == {"dates": "datetime", "last": "categorical", "between": "categorical", "none": "categorical"}
    assert 0 < seen.value < 1000
    before = seen.value
    assert sampling.parsing_columns(df) == ["dates", "last", "between"] and seen.value - before < 1000


def test_dates_parse_as_by_each_format_alone(spark):
    texts = [
        "2020-01-02", "2020-01-02 03:04:05", "2020-01-02T03:04:05", "2020-01-02t03:04:05", "1/2/2020", "02-01-2020", "2 Jan 2020", "2 jan 2020", "January 2, 2020", "january 2, 2020",
        "2020/01/02", " 2020-01-02", "2020-13-02", "-", "/", ":", ", ", "N/A", "", None, "2020-01-02 ", "12345-01-02", "+12345-01-02", "0000-01-01", "2020-02-30", "Jan 2, 2020", "555-010-1000", "1/2/20", "31-12-1999", "2\u00a0Jan 2020",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in catalogs.DATE_PARSE_FORMATS])
    assert df.where(~exprs.parse_date(F.col("t")).eqNullSafe(plain)).count() == 0 and df.where(plain.isNotNull()).count() >= 8


def test_a_pass_of_the_selection_reads_each_cell_once(spark, monkeypatch):
    """However many brackets of a column are open, a row gives one cell for the column."""
    seen, picked = [], quantiles._picked

    def counted(cells, *rest):
        seen.append(cells._jdf.queryExecution().optimizedPlan().toString().count("struct("))
        return picked(cells, *rest)

    monkeypatch.setattr(quantiles, "_picked", counted)
    monkeypatch.setattr(quantiles, "FEW", 10)
    df = spark.range(3000).selectExpr("CAST(id AS DOUBLE) AS a", "sqrt(id) AS b")
    assert quantiles.order_statistics(df, ["a", "b"])["a"] == [749.75, 1499.5, 2249.25]
    assert len(seen) > 1 and max(seen) <= 2


def test_equal_rows_weigh_as_many_and_bags_are_bounded(spark, monkeypatch):
    df = spark.range(20_000).select((F.xxhash64("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.xxhash64("id") % 5).alias("y"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("s"))
    df = df.withColumn("t", F.when((F.col("x") + F.coalesce("y", F.lit(0)) + (F.xxhash64("x", "y", "s") % 2)) > 1, "up").otherwise("down"))
    single = baseline.train(df, "t", "classification")
    seen, bagged = [], baseline.bagged
    monkeypatch.setattr(baseline, "bagged", lambda cells, size, tasks: seen.append((cells.count(), bagged(cells, size, tasks).agg(F.count(F.lit(1)).alias("bags"), F.sum("_n").alias("rows"), F.max("_n").alias("most")).first())) or bagged(cells, size, tasks))
    monkeypatch.setattr(baseline, "BAGS", 1000)
    packed = baseline.train(df, "t", "classification")
    (cells, got), = seen
    assert got["rows"] == 20_000 and got.most <= 20 and cells < 1500 and got.bags <= 1000 + cells
    assert single.quality == packed.quality and packed.value == pytest.approx(single.value, abs=0.02)


def test_groups_are_dealt_evenly_and_whole(spark):
    groups = spark.range(500).select((F.col("id") % 3).cast("double").alias("f0"), F.when(F.col("id") % 5 == 0, "rare").otherwise("often").alias("_target"), F.col("id").alias("_draw"), F.when(F.col("id") == 7, 100_000).otherwise(F.col("id") % 4 + 1).cast("long").alias("_n"))
    rows = {r["_target"]: r["n"] for r in groups.groupBy("_target").agg(F.sum("_n").alias("n")).collect()}
    got = baseline.parted(groups, ["f0"], "_target", 3, 2).groupBy("_target").pivot("_fold", [0, 1, 2]).agg(F.sum("_n")).collect()
    for r in got:
        folds = [r["0"], r["1"], r["2"]]
        assert sum(folds) == rows[r["_target"]] and max(folds) - min(folds) <= 1
    none = baseline.parted(groups.withColumn("_n", F.lit(6).cast("long")), ["f0"], "_target", 3, 2)
    assert none.agg(F.sum("_n")).first()[0] == 3000


def test_labels_without_signal_show_none(spark):
    df = spark.range(6000).select((F.xxhash64("id", F.lit(1)) % 4).alias("a"), (F.xxhash64("id", F.lit(2)) % 4).alias("b"), F.rand(3).alias("c"), F.when(F.xxhash64("id", F.lit(4)) % 2 == 0, "up").otherwise("down").alias("t"))
    assert baseline.train(df, "t", "classification").value < 0.53


def test_bins_of_numbers_and_medians_of_folds(spark):
    ready = spark.range(3000).select(
        (F.col("id") % 128).cast("double").alias("f0"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("f1"), F.lit(None).cast("double").alias("f2"), F.lit(5.0).alias("f3"),
        F.when(F.col("id") == 0, float("inf")).when(F.col("id") == 1, float("-inf")).otherwise(F.col("id") % 2 - 0.0).alias("f4"), (F.col("id") % 150).cast("double").alias("f5"), (F.col("id") % 3).cast("int").alias("_fold"),
    )
    rows, borders, gaps = baseline.edges(ready, ["f0", "f1", "f2", "f3", "f4", "f5"])
    assert rows == 3000 and borders["f0"] == list(range(1, 128)) and gaps == ["f1", "f2"] and borders["f2"] == borders["f3"] == []
    assert len(borders["f1"]) == 127 and 100 < len(borders["f5"]) <= 127
    bins = baseline.binned(ready, borders)
    assert bins.columns == ready.columns and bins.where("f1 is null").count() == 750 and bins.where("f2 is not null or f3 <> 0").isEmpty()
    sizes = [r["count"] for r in bins.where("f1 is not null").groupBy("f1").count().collect()]
    assert len(sizes) == 128 and max(sizes) < 2 * 2250 / 128
    assert bins.select("f0").distinct().count() == 128
    got = baseline.medians(bins.groupBy(*bins.columns).agg(F.count(F.lit(1)).alias("_n")), gaps, 3)
    for i in range(3):
        values = sorted(r.f1 for r in bins.where((F.col("_fold") != i) & F.col("f1").isNotNull()).select("f1").collect())
        assert got[i] == {"f1": values[(len(values) - 1) // 2], "f2": 0.0}


def test_a_large_table_is_dealt_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(baseline, "BAGS", 100)
    monkeypatch.setattr(baseline, "positions", None)
    groups = spark.range(30_000).select((F.col("id") % 3).cast("double").alias("f0"), F.when(F.col("id") % 5 == 0, "rare").otherwise("often").alias("_target"), F.xxhash64("id").alias("_draw"), F.when(F.col("id") % 2 == 0, 2).otherwise(4).cast("long").alias("_n"))
    for classes, each in ((2, {"rare": 18_000, "often": 72_000}), (None, {"rare": 18_000, "often": 72_000})):
        got = baseline.parted(groups, ["f0"], "_target", 3, classes).groupBy("_target").pivot("_fold", [0, 1, 2]).agg(F.sum("_n")).collect()
        for r in got:
            folds = [r["0"], r["1"], r["2"]]
            assert sum(folds) == each[r["_target"]] and max(folds) - min(folds) < (10 if classes else 0.03 * sum(folds))
    pairs = groups.where("_n = 2").withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    apart = baseline.split(pairs, "_target", 3, 2).groupBy("_draw").agg(F.count_distinct("_fold").alias("n"))
    assert apart.where("n = 2").count() > 0.97 * 15_000
