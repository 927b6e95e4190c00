"""Rules at and around their thresholds, odd tables, and whole reports."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dqengine.functions import exprs as E
from dqengine.operators import baseline, consistency, importance, leakage, profile, sampling, validation
from dqengine.plans import assess, display, issues, models, report, scoring
from dqengine.sources import tables
from dqengine.streaming import profile as streaming

Ev = scoring.Evidence


@pytest.fixture(scope="session")
def churn(spark):
    rows = [(f"c{i}", a, p, float(m), f"2024-0{1 + i % 9}-11", t) for i, (a, p, m, t) in enumerate([("30", "gold", 10, "yes"), ("thirty", "Gold", 20, "no"), ("41", "basic", 30, "no"), ("52", "basic ", 40, "yes"), ("N/A", "gold", 50, "no"), ("22", None, 60, "no"), ("35", "basic", 70, "yes"), ("47", "basic", 80, "no"), ("29", "gold", 90, "no"), ("61", "basic", 100, "yes"), ("33", "gold", 110, "no"), ("44", "basic", 999, "no")])]
    return spark.createDataFrame(rows, "customer_id string, age string, plan string, monthly double, signup_date string, churn string")


def test_moments_of_a_small_column(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (9.0,), (None,), (math.nan,)], "x double")
    r = profile.numeric_summary(df).first()
    assert (r.n, r.q25, r.std**2) == (5, 2.0, pytest.approx(10.3))
    assert r.skewness == pytest.approx(1.96936018) and r.kurtosis == pytest.approx(4.06918654)


def test_pairwise_correlation_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (None, 1.0, 1.0), (4.0, 9.0, 1.0)], "a double, b double, c double")
    r = {(x.column_a, x.column_b): x.r for x in profile.correlations(df).collect()}
    assert r["a", "b"] == pytest.approx(0.96312313730186) and r["a", "c"] is None


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, 2)], "a int, b int")
    assert tuple(profile.duplicates(df).first()) == (3, 1, 33.33, 2)


@pytest.mark.parametrize("rows", [[], [(1.5, "a", True)], [(None, None, None)] * 3, [(math.inf, "x", False), (-math.inf, "y", True), (math.nan, "z", None)]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "x double, s string, b boolean")
    assert profile.missing(df).count() == 3 and profile.duplicates(df).count() == 1
    for made in (profile.numeric_summary, profile.outliers, profile.correlations, profile.categorical_features, profile.numeric_features, profile.unique_ratio, profile.binary_columns, profile.missing_summary):
        made(df).collect()
    values = consistency.distinct_values(df)
    for made in (consistency.mixed_types, consistency.noise, consistency.unit_inconsistencies, consistency.format_inconsistencies, consistency.abbreviation_pairs, consistency.spelling_variants):
        made(values).collect()


def test_partitions_do_not_matter(spark, churn):
    a, b = profile.numeric_summary(churn.repartition(7)).first(), profile.numeric_summary(churn.coalesce(1)).first()
    assert list(a)[1:] == pytest.approx(list(b)[1:])


def test_numbers_in_text(spark):
    texts = {"1_000": True, "nan": True, "inf": True, " 12 ": True, "1e5": True, "1d": False, "1f": False, "0x10": False, "": False, ".5": True, "5.": True, "+-3": False, "1__0": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", E.is_numeric(F.col("t")).alias("n")).collect()} == texts


def test_value_classes(spark):
    want = {"7": "numeric", "thirty": "text_numeric", "secondary": "text_numeric", "3rd": "text_numeric", "Yes": "boolean_like", "1/2/2024": "datetime_like", "2024-01-05x": "datetime_like", "blue": "categorical", "1": "numeric"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.c for r in df.select("t", E.value_class(F.col("t")).alias("c")).collect()} == want


def test_consistency_of_the_churn_table(churn):
    found = consistency.check(churn)
    assert found.mixed["age"] == "high" and found.noise["age"] == "medium" and found.categorical == {"plan"}
    assert found.score == 100 - 20 - 8 - 8
    assert consistency.check(churn, compat=True).score == 100 - 20 - 8
    assert found.recommendations()


def test_target_detection(spark, churn):
    assert profile.detect_target(churn) == "churn" and profile.detect_target(churn, "age") == "age"
    assert profile.detect_target(spark.createDataFrame([(1, 5)], "a int, b int")) == "a"
    assert profile.detect_target(spark.createDataFrame([(3, 5)], "a int, b int")) == "b"
    with pytest.raises(ValueError):
        profile.detect_target(churn, "nope")


def test_leakage(spark, churn):
    hits = {(h["column"], h["pattern"], h["match"]) for h in leakage.name_hits(["l_discount", "User ID", "o_totalprice", "plain"], {"own": ["plai"]})}
    assert hits == {("l_discount", "count_", "partial"), ("User ID", "user_id", "exact"), ("o_totalprice", "total_", "partial"), ("plain", "plai", "custom")}
    found = leakage.check(churn, "churn", datetime(2024, 5, 1))
    assert found.overall() == "high" and found.recommendations()
    assert [(h["column"], h["future"]) for h in found.future] == [("signup_date", 5.0)]
    dates = leakage.Leakage(future=found.future)
    assert dates.risks() == {"signup_date": "medium"} and dates.risks(compat=True) == {}
    nothing = leakage.check(spark.createDataFrame([(1, "a"), (1, "b")], "x int, y string"), None, datetime(2024, 1, 1))
    assert nothing.overall() == "low"


def test_information_bins_numbers(spark):
    df = spark.range(2000).select((F.col("id") % 1000).alias("x"), (F.col("id") % 1000 >= 500).cast("int").alias("y"), (F.xxhash64("id") % 1000).alias("z"))
    mi = {r.feature: r.mi for r in importance.mutual_information(df, "y").collect()}
    assert mi["x"] > 0.65 and mi["z"] < 0.05


def test_baseline_model(spark):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 3, "up").otherwise("down").alias("t"), ((F.col("id") % 7) * 2.0).alias("v"), F.lit("k").alias("c"))
    good = baseline.train(df, "t", "classification")
    assert good.value > 0.95 and good.quality == "excellent" and good.score() == 90 and good.score(compat=True) == 30
    assert baseline.train(df.drop("t"), "v", "regression").value > 0.8
    assert baseline.train(df.limit(5), "t", "classification").quality == "insufficient_data"
    assert baseline.train(df.where("t = 'up'"), "t", "classification").value == 0.0
    assert [baseline.folds_for(*x) for x in ((20, None), (500, None), (500, 2), (500, 9), (20, 9))] == [3, 5, 2, 5, 3]


@pytest.mark.parametrize(("value", "name"), [(0.85, "excellent"), (0.849, "good"), (0.75, "good"), (0.65, "moderate"), (0.55, "weak"), (0.5499, "very_weak")])
def test_accuracy_bands(value, name):
    assert baseline.band(value, baseline.ACCURACY_BANDS) == name


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: scoring.consistency(Ev(high_pairs=5)), 90),
        (lambda: scoring.consistency(Ev(high_pairs=6)), 94),
        (lambda: scoring.consistency(Ev(high_pairs=40, outlier_pct={str(i): 16 for i in range(9)})), 65),
        (lambda: scoring.consistency(Ev(outlier_pct={"a": 15.0})), 100),
        (lambda: scoring.signal(Ev(max_abs_r=0.81, low_variance=1)), 70),
        (lambda: scoring.signal(Ev(max_abs_r=0.3)), 40),
        (lambda: scoring.signal(Ev(target="t", signal_points=90, low_variance=9, max_mi=0.04)), 55),
        (lambda: scoring.signal(Ev(target="t", signal_points=90, max_mi=0.05)), 80),
        (lambda: scoring.signal(Ev(target="t", signal_points=90, max_mi=0.1)), 90),
        (lambda: scoring.suitability(Ev()), 50),
        (lambda: scoring.suitability(Ev(rows=1000, target="t", problem="classification", imbalance=51.0, target_classes=2)), 65),
        (lambda: scoring.suitability(Ev(rows=1000, target="t", problem="classification", imbalance=5.0, target_classes=101)), 75),
        (lambda: scoring.suitability(Ev(rows=10, target="t", problem="classification", target_classes=6)), 65),
        (lambda: scoring.suitability(Ev(rows=10, target="t", problem="regression", target_std=0.0, leakage_risk="high", target_missing=99)), 0),
        (lambda: scoring.quantity(Ev(rows=500, columns=6)), 95),
        (lambda: scoring.completeness(Ev(rows=0)), 50),
        (lambda: scoring.blend_weight("HIGH", "HIGH"), 0.45),
        (lambda: scoring.blend_weight("LOW", "LOW"), 0.05),
        (lambda: scoring.blend_weight(None, None), 0.20),
        (lambda: scoring.blend(60, 100, 0.2), 63.0),
        (lambda: scoring.compounding_penalty(3, 50), 0),
        (lambda: scoring.compounding_penalty(5, 50), 0.15 * 50 * 0.44),
        (lambda: scoring.combination_penalty([{"issue_type": t} for t in ("mixed_data_types", "semantic_nulls", "x")]), 10),
        (lambda: scoring.coverage_penalty([{"verification_details": "widespread", "affected_columns": ["a"] * 4}] * 5), 10),
        (lambda: scoring.non_linear(12, [{"issue_type": "mixed_data_types", "severity": "CRITICAL", "affected_columns": ["a"], "validation_status": "VERIFIED"}])["score"], 10),
        (lambda: scoring.non_linear(70, [{"validation_status": "PARTIAL"}])["score"], 70),
    ],
)
def test_scores(made, want):
    assert made() == pytest.approx(want)


def test_quality_is_bounded_and_weighted():
    best = scoring.quality(Ev(rows=10_000, columns=5, target="t", problem="classification", target_classes=2, signal_points=90, max_mi=0.5))
    assert best["overall"] == pytest.approx(0.2 * 95 + 0.2 * 100 + 0.2 * 100 + 0.25 * 90 + 0.15 * 90) and best["grade"] == "A"
    worst = scoring.quality(Ev(consistency=0, missing_pct=100, duplicate_pct=100))
    assert 0 <= worst["overall"] < 60 and worst["breakdown"]["target_suitability"]["grade"] == "C"


def test_issues_and_steps():
    e = Ev(rows=50, columns=60, missing_pct=21, missing_by_column={"a": 50.0}, duplicate_pct=11, balanced=False, imbalance=12, high_pairs=1, high_cardinality=3, low_variance=1, categorical=6, numerical=2, target="t")
    found = issues.detected(e)
    assert [(i["category"], i["severity"]) for i in found] == [("missing_data", "high"), ("duplicates", "medium"), ("class_imbalance", "high"), ("correlation", "medium"), ("high_cardinality", "low"), ("low_variance", "low")]
    assert issues.severity_counts(found) == {"high": 2, "medium": 2, "low": 2}
    assert [s["priority"] for s in issues.preprocessing(e)] == [1, 2, 3, 4, 5]
    assert issues.complexity(e) == "high" and issues.size_category(99) == "very_small" and issues.size_category(100_000) == "very_large"
    assert len(issues.suggested_steps(e)) == 5 and ("high", "more columns than rows") in issues.risk_factors(e) and issues.readiness(e)
    assert not issues.detected(Ev(rows=10)) and issues.samples_per_feature(Ev(rows=10, columns=3, target="t")) == 5


def test_model_ranking():
    few = models.ranking(Ev(rows=90, columns=5, categorical=2, max_mi=0.05), "classification")
    assert [m["rank"] for m in few] == [1, 2, 3] and few[0]["model_name"] in ("Random Forest Classifier", "Logistic Regression")
    many = models.ranking(Ev(rows=60_000, columns=20, missing_pct=16, categorical=6, numerical=10, max_mi=0.6), "regression")
    assert many[0]["model_name"] in ("XGBoost Regressor", "LightGBM Regressor") and many[0]["confidence_score"] == 100
    f = models.fingerprint(Ev(rows=200, columns=30, max_mi=0.3))
    assert models.score(("ElasticNet Regression", False, False, True), f, "regression") == min(100, 50 + 25 + 20 + 25)
    assert models.family("ElasticNet Regression") == "elastic" and models.family("Linear Regression") == "linear"


def test_samples(spark, churn):
    keyed = tables.with_row_id(churn)
    rows = sampling.stratified(keyed, "_row_id")
    kinds = {r["issue_type"] for r in rows}
    assert {"mixed_types", "semantic_nulls", "baseline"} <= kinds and len(rows) <= 50
    assert sampling.summary(rows)["total"] == len(rows)
    assert sampling.time_thirds(spark.range(10).withColumn("t", F.current_timestamp()), "t", "id").count() == 0
    sizes = {r.third: r["count"] for r in sampling.time_thirds(spark.range(20).withColumn("t", F.timestamp_seconds("id")), "t", "id").groupBy("third").count().collect()}
    assert sizes == {"early": 6, "middle": 8, "late": 6}
    few = spark.createDataFrame([(1, None, 2), (2, None, None), (3, 1, None)], "id long, a int, b int")
    assert sampling.baseline_rows(few, "id").count() == 3
    assert [r.id for r in sampling.missing_rows(few, 5, "id").collect()] == [2]
    assert [r.id for r in sampling.co_missing_rows(few, 5, "id").collect()] == [2]
    assert sampling.blank_rows(spark.createDataFrame([(1, " "), (2, "x")], "id long, s string"), 5, "id").count() == 1
    assert sampling.mixed_rows(churn, "age", "customer_id").count() == 4
    assert sampling.dominant_rows(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, s string"), "s", "id").first().id == 1


@pytest.mark.parametrize(("verified", "partial", "want"), [(0.81, 0, "HIGH"), (0.8, 0, "MEDIUM"), (0.4, 0.21, "MEDIUM"), (0.3, 0.29, "LOW")])
def test_claim_confidence(verified, partial, want):
    assert validation.confidence(verified, partial) == want


def test_no_claims_hold(churn):
    assert validation.validate(churn, [], "customer_id")["verified_rate"] == 1.0


def test_assessor(churn):
    asked = []

    def assessor(question):
        asked.append(question)
        return 'Here: {"adjusted_quality_score": "20", "confidence_level": "HIGH", "blocking_issues": [{"issue_type": "mixed_data_types", "severity": "CRITICAL", "affected_columns": ["age"], "description": "ages", "sample_evidence": ["30", "thirty"]}], "recommended_fixes": [{"issue_type": "semantic_nulls", "fix_description": "fix", "python_code": "x"}]}'

    own = report.analyze(churn, as_of=datetime(2024, 5, 1), with_model=False)
    told = report.analyze(churn, as_of=datetime(2024, 5, 1), with_model=False, assessor=assessor, key="customer_id")
    assert asked and told["quality_score"]["overall"] == scoring.blend(own["quality_score"]["overall"], 20, 0.45)
    assert told["insights"]["action_items"][1] == {"action": "fix", "impact": "HIGH", "effort": "4-8 hours"}


def test_answers():
    full = assess.read_answer({"adjusted_quality_score": 300, "blocking_issues": [{"severity": "CRITICAL", "sample_evidence": [1, 2]}] * 3, "recommended_fixes": [1], "samples_analyzed": 21, "critical_issues_found": 1, "confidence_level": "HIGH"})
    assert full["adjusted_quality_score"] == 100 and assess.confidence(full) == (100, "VERY_HIGH")
    assert assess.read_answer("nothing") == {"error": "no JSON object"} and assess.insights({"error": "x"}) is None
    assert assess.confidence(assess.read_answer({"confidence_level": "LOW"}))[1] == "VERY_LOW"
    assert assess.reliability("MEDIUM", full) == "MODERATELY_RELIABLE" and assess.reliability("LOW", full) == "UNRELIABLE" and assess.reliability("MEDIUM", {}) == "QUESTIONABLE"
    assert assess.agreement(full, 94, {"critical_count": 2}) == {"score_alignment": 0.8, "sample_alignment": 1.0, "overall_consistency": 0.9}
    assert assess.fallback([{"severity": "high", "recommendation": "r"}])["action_items"] == ["r"]


def test_files(spark, tmp_path, churn):
    (tmp_path / "t.csv").write_text('a,b,"c d"\n1,x,N/A\n2,"y,""z",null\n3,,w\n')
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b", "c d"] and [r["c d"] for r in df.collect()] == [None, None, "w"] and df.collect()[1].b == 'y,"z'
    assert tables.header(spark, str(tmp_path / "t.csv")) == ["a", "b", "c d"] and tables.metadata(df).count() == 3
    for kind in ("parquet", "json", "orc"):
        churn.write.format(kind).save(f"{tmp_path}/c.{kind}")
        assert tables.read_table(spark, f"{tmp_path}/c.{kind}").count() == 12
    assert tables.size_mb(spark, f"{tmp_path}/c.parquet") > 0
    for bad in ("x.xlsx", "x.exe", "x.c"):
        with pytest.raises(tables.UnsupportedFile):
            tables.read_table(spark, bad)
    with pytest.raises(tables.EmptyTable):
        tables.check(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError):
        report.analyze(churn, problem_type="other")
    made = report.analyze_file(spark, f"{tmp_path}/c.parquet", with_model=False, as_of=datetime(2024, 5, 1))
    tables.write_report(report.as_table(spark, made), f"{tmp_path}/report")
    back = spark.read.json(f"{tmp_path}/report").first()
    assert back.dataset_info.detected_target_column == "churn" and len(back.model_recommendations) == 3


def test_running_profile_replaces_a_batch_run_again(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    for batch in (0, 1, 1):
        streaming.partial_sums(df, ["x"]).write.mode("overwrite").parquet(f"{tmp_path}/p/batch={batch}")
    r = streaming.merged(spark.read.parquet(f"{tmp_path}/p")).first()
    assert (r.n, r.missing, r.mean, r.min, r.max) == (4, 2, 2.0, 1.0, 3.0) and r["std"] == pytest.approx(2 / math.sqrt(3))


def test_watermarked_stream(spark, tmp_path):
    spark.range(0, 100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").cast("double").alias("v")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/in")
    q = streaming.windowed_profile(stream, "ts", ["v"]).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.sql("SELECT sum(n) AS n, count(*) AS windows FROM closed").first()
    assert closed.windows >= 13 and closed.n == 6 * closed.windows


def test_reports_from_sketches_and_whole_details(spark, churn):
    exact, rough = (report.analyze(churn, as_of=datetime(2024, 5, 1), with_model=False, exact=x, keep=x) for x in (True, False))
    assert exact["quality_score"] == rough["quality_score"]
    p = exact["data_profile"]
    assert p["missing"] == {"plan": 8.33} and p["outliers"]["monthly"]["outliers"] == 1 and p["categorical_features"]["churn"]["mode"] == "no"
    assert p["leakage"]["risk"] == "high" and len(p["leakage"]["recommendations"]) <= 3 and p["consistency"]["columns"]["mixed_types"] == ["age"]
    assert p["numeric_features"]["monthly"]["n_unique"] == 12 and p["categorical_summary"]["binary"] == 1.0 and p["high_correlations"] == []
    assert report.as_table(spark, exact).select("data_profile.consistency.score").first()[0] == p["consistency"]["score"]


def test_folds_do_not_depend_on_partitions(spark):
    df = spark.range(400).select((F.col("id") % 9).cast("double").alias("x"), (F.xxhash64("id") % 5).alias("z"), F.when((F.col("id") * 7 + F.xxhash64("id") % 4) % 9 > 4, "up").otherwise("down").alias("t"))
    assert baseline.train(df.coalesce(1), "t", "classification").value == pytest.approx(baseline.train(df.repartition(5), "t", "classification").value, abs=0.03)


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3,4,5,6\n")
    with pytest.raises(tables.UnreadableFile):
        df = tables.read_table(spark, str(tmp_path / "bad.csv"), schema="a int, b int")
        tables.check(df.where("a = 3"))
    (tmp_path / "t.csv").write_text('a, "b" ,\n1,2,3\n')
    assert tables.header(spark, str(tmp_path / "t.csv"))[:2] == ["a", "b"]
    one = tables.metadata(spark.createDataFrame([(1, "x")], "a int, s string"), "t", 0.5).orderBy("position").collect()
    assert [(r.column, r.type, r.table, r.rows, r.size_mb) for r in one] == [("a", "int", "t", 1, 0.5), ("s", "string", "t", 1, 0.5)]


def test_samples_of_outliers_gaps_and_text_dates(spark):
    rows = [(i, float(i % 5) if i not in (7, 8, 9, 10) else (-1) ** i * 1000.0, None if i % 3 == 0 else "a", None if i % 3 == 0 else 1.0, f"2024-01-{1 + i % 28:02}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v double, s string, w double, when_made string")
    found = sampling.stratified(df, "id")
    kinds = {(r["issue_type"], r["column"]) for r in found}
    assert {("outlier", "v"), ("missing_together", None), ("temporal", "when_made"), ("many_missing", None)} <= kinds
    assert sampling.parsing_columns(df) == ["when_made"] and sampling.temporal_column(df.drop("when_made"), "id") is None
    plain = sampling.stratified(df.select("id", "w"), "id")
    assert ("spread", None) in {(r["issue_type"], r["column"]) for r in plain}


def test_rules_of_models_by_family():
    from itertools import product

    def plain(model, f, problem):
        """The same points, added rule by rule."""
        name, missing_ok, cats, readable = model
        kind, small = models.family(name), f.size in ("tiny", "small")
        lines = [
            {"boost": {"tiny": -15, "small": 10}.get(f.size, 20), "forest": 5 if f.size == "tiny" else 15, "linear": 15 if small else 20 if f.high_dimensional else 5, "svm": 15 if small else 20 if f.high_dimensional else -10, "elastic": 25 if f.high_dimensional or f.correlated_pairs > 5 else 10 if f.size in ("small", "medium") else 5}[kind],
            0 if f.missing == "none" else 15 if missing_ok else -15,
            0 if f.category_ratio == 0 else -(10 + int(10 * f.category_ratio)) if not cats else 20 if kind == "boost" and f.category_ratio > 0.5 else 10,
            (15 if f.severe else 10) if problem == "classification" and f.imbalanced else 0,
            0 if not f.robust else 15 if "XGBoost" in name or kind == "forest" else -10 if kind == "linear" else 0,
            0 if not f.interpretable else 20 if readable else -10,
            0 if not f.high_dimensional else {"elastic": 25, "svm": 25, "linear": 15}.get(kind, -5),
            (10 * readable + 5 * (kind == "linear")) if f.weak_signal else 15 if f.strong_signal and ("XGBoost" in name or kind == "forest") else 0,
            0 if not f.fast else 20 if "LightGBM" in name else {"linear": 15, "forest": -5, "svm": -15}.get(kind, 0),
            15 if f.heavy and missing_ok and cats else 0,
        ]
        return max(0.0, min(100.0, 50.0 + sum(lines)))

    flags = (False, True)
    for size, missing, ratio, pairs in product(("tiny", "small", "medium", "large"), ("none", "low"), (0, 0.3, 0.6), (0, 6)):
        for bits in product(flags, repeat=6):
            wide, unbalanced, weak, robust, readable, fast = bits
            f = models.Fingerprint(size, wide, missing, pairs, ratio, unbalanced, unbalanced and weak, weak, not weak, robust, readable, fast, ratio > 0.5)
            for problem, many in (("classification", models.C.CLASSIFIERS), ("regression", models.C.REGRESSORS)):
                assert [models.score(m, f, problem) for m in many] == [plain(m, f, problem) for m in many]


def test_column_classes(spark):
    df = spark.createDataFrame([("2024-01-05", "x", 1, True, 1.5)], "d string, s string, i int, b boolean, f double").withColumn("t", F.current_timestamp())
    assert profile.column_classes(df) == {"d": "datetime", "s": "categorical", "i": "numerical", "b": "boolean", "f": "numerical", "t": "datetime"}


def test_display():
    assert [display.confidence_band(p) for p in (80, 79.9, 60, 59)] == ["high", "medium", "medium", "low"]
    assert [display.short_number(n) for n in (999, 1000, 1_250_000)] == ["999", "1.0K", "1.2M"]


def test_column_classes_of_all_rows(spark):
    day = "CASE WHEN id > 0 THEN '2024-01-02' END AS nulls_first"
    df = spark.range(3000).coalesce(1).selectExpr(day, "CASE WHEN id < 2999 THEN '2024-01-02' ELSE 'odd' END AS odd_last", "CAST(NULL AS STRING) AS none")
    assert profile.column_classes(df) == {"nulls_first": "datetime", "odd_last": "categorical", "none": "categorical"}


def test_claims_are_checked_over_all_rows(spark):
    df = spark.range(600).selectExpr("id", "CASE WHEN id < 300 THEN '5' ELSE 'odd' END AS v", "CASE WHEN id < 300 THEN '2024-01-02' ELSE '01/02/2024' END AS d")
    claims = [{"issue_type": "mixed", "affected_columns": ["v"]}, {"issue_type": "format", "affected_columns": ["d"]}]
    assert [c["validation_status"] for c in validation.validate(df, claims, "id")["claims"]] == ["VERIFIED", "VERIFIED"]
    assert validation.mixed_shares(df, "v", "id", head=200).first().numeric == 1.0
