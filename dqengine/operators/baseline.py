"""A small random forest, cross-validated with pyspark.ml, as a measure of the signal in a table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.functions import exprs as E
from dqengine.operators import profile
from dqengine.operators.sampling import positions

ACCURACY_BANDS = [(0.85, "excellent"), (0.75, "good"), (0.65, "moderate"), (0.55, "weak")]
R2_BANDS = [(0.80, "excellent"), (0.65, "good"), (0.50, "moderate"), (0.35, "weak")]
SIGNAL_SCORES = {"excellent": 90, "good": 75, "moderate": 60, "weak": 45, "very_weak": 30, "insufficient_data": 20}
TASK_ROWS = 500_000
"""Rows or bags of a task of the forest, which keeps some 300 bytes of each."""
BAGS = 1_000_000
"""Rows of a table up to which the bootstrap draws single rows; of larger tables it draws bags of equal rows, about as many."""
BINS = 128
"""Bins of a number, as the forest's own."""


@dataclass
class Signal:
    metric: str
    value: float
    quality: str

    def score(self, compat: bool = False) -> int:
        """Points of the signal; in compat mode always 30."""
        return 30 if compat else SIGNAL_SCORES.get(self.quality, 25)


def band(value: float, bands: list[tuple[float, str]]) -> str:
    return next((name for least, name in bands if value >= least), "very_weak")


def prepared(df: DataFrame, target: str, most_values: int = 100) -> tuple[DataFrame, list[str]]:
    """Rows with a target, and the features to use: numbers, and strings of at most ``most_values`` values."""
    rows = df.where(E.q(target).isNotNull())
    texts = [c for c in E.string_columns(df) if c != target]
    counts = {r["column"]: r.n_unique for r in profile.categorical_features(rows, texts).collect()} if texts else {}
    kept = [c for c in texts if counts.get(c, 0) <= most_values]
    numbers = [c for c in E.numeric_columns(df) if c != target]
    flags = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) and f.name != target]
    columns = [E.number(c).alias(f"f{i}") for i, c in enumerate(numbers)]
    columns += [E.q(c).cast("double").alias(f"f{len(numbers) + i}") for i, c in enumerate(flags)]
    columns += [F.coalesce(E.q(c), F.lit("missing")).alias(f"s{i}") for i, c in enumerate(kept)]
    return rows.select(E.q(target).alias("_target"), *columns), [*(f"f{i}" for i in range(len(numbers) + len(flags))), *(f"s{i}" for i in range(len(kept)))]


def folds_for(rows: int, classes: int | None) -> int:
    folds = 3 if rows < 30 else 5
    return max(2, min(folds, classes)) if classes is not None else folds


def _side_by_side(fit: Callable[[int], float], k: int) -> list[float]:
    """Results of k fits whose jobs share the cluster."""
    spark = SparkSession.getActiveSession()
    with ThreadPoolExecutor(k) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), range(k)))


def dealt(ready: DataFrame, features: list[str], label: str, k: int, rows: int, classes: int | None, seed: int = 42) -> DataFrame:
    """Features, label and ``_fold`` of every row. Rows are placed by class (if there are any) and a hash of their values. Class starts
    are broadcast, as a join on the class would bring a class to one task; rows go to tasks by place, at most about ``TASK_ROWS`` to each."""
    drawn = ready.withColumn("_draw", F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(ready.columns)]))  # the row's values, not its place
    # Equal rows follow each other, so places deal them to all folds, whichever of them comes first.
    placed = positions(drawn, [*([F.col(label)] if classes is not None else []), F.col("_draw")])
    place = F.col("_place")
    if classes is not None:
        first = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_place").alias("_first"))
        placed = placed.join(F.broadcast(first), F.col(label) == F.col("_class"))
        place = place - F.col("_first")
    tasks = max(ready.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return placed.select(*features, label, F.pmod(place, F.lit(k)).alias("_fold"), "_place").repartition(tasks, "_place").drop("_place")


def edges(ready: DataFrame, numbers: list[str]) -> tuple[int, dict[str, list[float]], list[str]]:
    """Rows; borders of at most ``BINS`` bins of each number; and numbers with nulls. A number of no more values has a bin for each,
    one of up to about twice as many is cut at every so-manieth value, others at quantiles of the rows. Labels have no part in it."""
    at, step = [i / BINS for i in range(1, BINS)], E.WIDE // 2
    rows, few, gaps = 0, set(), []
    for i in range(0, max(1, len(numbers)), step):
        part = numbers[i : i + step]
        rows, *got = ready.agg(F.count(F.lit(1)), *[m for c in part for m in (F.count(c), F.approx_count_distinct(c))]).first()
        gaps += [c for c, n in zip(part, got[::2]) if n < rows]
        few |= {c for c, n in zip(part, got[1::2]) if n <= 2 * BINS}  # an estimate, off by a twentieth
    found = {}
    for i in range(0, len(numbers), step):
        part = numbers[i : i + step]
        found |= dict(zip(part, ready.agg(*[F.collect_set(c) if c in few else F.percentile_approx(c, at, 10_000) for c in part]).first()))
    for c in few:
        values = sorted(found[c])
        found[c] = values[1:] if len(values) <= BINS else [values[int(p * len(values))] for p in at]
    return rows, {c: sorted({b + 0.0 for b in v or [] if abs(b) < float("inf")}) for c, v in found.items()}, gaps


def binned(ready: DataFrame, borders: dict[str, list[float]]) -> DataFrame:
    """Numbers replaced by the count of borders up to them, which is all that a tree sees of them; nulls stay."""
    cut = [c for c, v in borders.items() if v]
    if cut:
        splits = [[-float("inf"), *borders[c], float("inf")] for c in cut]
        ready = Bucketizer(splitsArray=splits, inputCols=cut, outputCols=[f"b_{c}" for c in cut], handleInvalid="keep").transform(ready)
    whole = lambda c: F.col(f"b_{c}") if borders[c] else F.lit(0.0)
    return ready.select(*[F.when(F.col(c).isNotNull(), whole(c)).alias(c) if c in borders else F.col(c) for c in ready.columns if not c.startswith("b_")])


def split(rest: DataFrame, label: str, k: int, classes: int | None) -> DataFrame:
    """``_fold`` of each row of a large table without a sort: a class is cut in k parts of its draws, even to a ten-thousandth of the class.
    Copies of a row (``_copy``) are set a k-th of all draws apart, so they go to different folds."""
    turn = F.col("_draw") / F.lit(2.0**64) + F.lit(0.5) + F.col("_copy") / F.lit(float(k))
    rest = rest.withColumn("_turn", turn - F.floor(turn))
    own = F.lit(0) if classes is None else F.col(label)
    marks = rest.groupBy(own.alias("_class")).agg(F.percentile_approx("_turn", [i / k for i in range(1, k)], 10_000).alias("_marks"))
    joined = rest.join(F.broadcast(marks), own == F.col("_class"))
    return joined.withColumn("_fold", F.size(F.filter("_marks", lambda m: F.col("_turn") > m)))


def parted(groups: DataFrame, features: list[str], label: str, k: int, classes: int | None, seed: int = 42) -> DataFrame:
    """Features, label, ``_fold`` and ``_n`` rows, from groups of ``_n`` equal rows that ``_draw`` tells apart: each fold gets as many of a
    group as the others, what is left over is dealt row by row. Rows that only fall in the same bins are dealt like any others:
    dealt evenly, they would show a fold what it is tested on."""
    over = F.pmod("_n", F.lit(k))
    names = [*features, label, F.col("_fold").cast("int").alias("_fold")]
    even = groups.withColumn("_n", F.floor(F.col("_n") / k)).where("_n > 0").withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rest = groups.where(over > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), over))).drop("_n")
    left = groups.agg(F.sum(over)).first()[0]
    rest = dealt(rest.drop("_copy"), features, label, k, left, classes, seed) if left <= BAGS else split(rest, label, k, classes)
    both = even.select(*names, "_n").unionByName(rest.select(*names, F.lit(1).cast("long").alias("_n")))
    return both.groupBy(*features, label, "_fold").agg(F.sum("_n").alias("_n"))


def bagged(parts: DataFrame, size: int, tasks: int) -> DataFrame:
    """Parts cut into bags of at most ``size`` rows, as even as can be, which are spread over the tasks."""
    bags = F.ceil(F.col("_n") / size)
    cut = parts.withColumn("_bags", bags).withColumn("_bag", F.explode(F.sequence(F.lit(1), F.col("_bags"))))
    share = F.floor(F.col("_n") / F.col("_bags")) + (F.col("_bag") <= F.col("_n") % F.col("_bags")).cast("long")
    return cut.withColumn("_n", share.cast("double")).drop("_bags").repartition(tasks, *[c for c in cut.columns if c != "_bags"]).drop("_bag")


def medians(cells: DataFrame, numbers: list[str], k: int) -> list[dict[str, float]]:
    """For each fold the bin of each number that holds the median of the other folds' rows; 0 where they have no value."""
    found = [dict.fromkeys(numbers, 0.0) for _ in range(k)]
    if numbers:
        values = F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_x")) for c in numbers]))
        counts = cells.select("_fold", "_n", values).where("_x is not null").groupBy("_c", "_x", "_fold").agg(F.sum("_n").alias("_n"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("_fold"))).alias("_out")
        counts = counts.select("_c", "_x", "_n", others).groupBy("_c", "_out", "_x").agg(F.sum("_n").alias("_n"))
        of = Window.partitionBy("_c", "_out")
        upto = counts.withColumn("_upto", F.sum("_n").over(of.orderBy("_x"))).withColumn("_all", F.sum("_n").over(of))
        for r in upto.where("2 * _upto >= _all").groupBy("_c", "_out").agg(F.min("_x").alias("_x")).collect():
            found[r["_out"]][r["_c"]] = r["_x"]
    return found


def train(df: DataFrame, target: str, problem: str, seed: int = 42) -> Signal:
    """Mean accuracy or R2 over the folds. Classes are dealt to the folds evenly: rows are placed by class and a hash of their values, and
    the place within the class gives the fold (in large tables the part of the class's hashes); so folds don't depend on how the table is laid out. A tree sees of a number its bin alone,
    so rows of a fold that are equal after binning are counted once and weigh as many: a large table comes down to its different
    cells. The bootstrap draws bags of equal rows of a fold: single rows in tables of up to ``BAGS`` rows, at most rows / ``BAGS`` of them in
    larger ones; every row is in one bag. Medians and codes of texts are learned from the other folds, as the forest is; borders
    of bins come from the features of all rows. Folds are fitted side by side."""
    ready, features = prepared(df, target)
    metric = "accuracy" if problem == "classification" else "r2"
    numbers = [c for c in features if c.startswith("f")]
    texts = [c for c in features if c.startswith("s")]
    label = "_target" if problem == "classification" else "label"
    ready = ready.select(F.col("_target").cast("string" if problem == "classification" else "double").alias(label), *features)
    rows, borders, gaps = edges(ready, numbers)
    if rows < 10 or not features:
        return Signal(metric, 0.0, "insufficient_data")
    drawn = ready.withColumn("_draw", F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(ready.columns)]))
    groups = binned(drawn, borders).groupBy(label, *features, "_draw").agg(F.count(F.lit(1)).alias("_n")).persist()
    cells = table = None
    try:
        classes = None
        if problem == "classification":
            classes = groups.select(label).distinct().count()
            if classes < 2:
                return Signal(metric, 0.0, "very_weak")
        k = folds_for(rows, classes)
        cells = parted(groups, features, label, k, classes, seed).persist()
        different = cells.count()
        groups.unpersist()
        size = -(-rows // BAGS)
        most = rows if size == 1 else rows // size + different
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_ROWS))
        # Five rows to a leaf: counted where a bag is a row, else by weight.
        least = {"minInstancesPerNode": 5} if size == 1 else {"minInstancesPerNode": 1, "minWeightFractionPerNode": 4.5 * k / ((k - 1) * rows)}
        options = {"weightCol": "_n", "numTrees": 50, "maxDepth": 5, "maxBins": BINS, "seed": seed, **least}
        stages = []
        if texts:
            stages.append(StringIndexer(inputCols=texts, outputCols=[f"x_{c}" for c in texts], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(VectorAssembler(inputCols=[c if c in borders else f"x_{c}" for c in features], outputCol="features", handleInvalid="keep"))
        if problem == "classification":
            forest, evaluator = RandomForestClassifier(**options), MulticlassClassificationEvaluator(metricName="accuracy", weightCol="_n")
        else:
            forest, evaluator = RandomForestRegressor(featureSubsetStrategy="all", **options), RegressionEvaluator(metricName="r2", weightCol="_n")
        table = bagged(cells, size, tasks).persist()
        middle = medians(cells, gaps, k)
        coded = table
        if problem == "classification":
            coded = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(table).transform(table)  # labels, not features: every class has a code

        def fit(i: int) -> float:
            filled = coded.fillna(middle[i]) if gaps else coded
            return evaluator.evaluate(Pipeline(stages=[*stages, forest]).fit(filled.where(F.col("_fold") != i)).transform(filled.where(F.col("_fold") == i)))

        value = max(0.0, sum(_side_by_side(fit, k)) / k)
        return Signal(metric, value, band(value, ACCURACY_BANDS if problem == "classification" else R2_BANDS))
    finally:
        for kept in (groups, cells, table):
            if kept is not None:
                kept.unpersist()
