"""Mutual information of a continuous and a discrete column from nearest neighbours, in nats, exact in its one dimension.

A value's ball reaches to its k-th nearest neighbour of the same class, which is not in it; how many of all values lie in the ball, against how
many of its class do, tells how far the class is apart from the others. Where a value stands so often in its class that this neighbour is
equal to it, the ball is that value alone.

All columns are worked out together. Positions in the order of (column, class, value) cut each class into blocks; blocks also get
the k values before and after them, so that neighbours are found by windows of bounded size, across the edges of blocks. Values in
balls are counted by one more sort, of values and ends of balls, and running sums: no task gathers a class or a ball.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.functions import exprs as E
from dqengine.functions.lineage import cut
from dqengine.operators import importance
from dqengine.operators.quantiles import order_statistics
from dqengine.operators.sampling import positions

NEIGHBOURS = 3
BLOCK = 8192
"""Values of a class in one block."""


def digamma(n: Column) -> Column:
    """Of a whole number from 1: ten steps of the recurrence, then the asymptotic series."""
    y = n.cast("double") + 10.0
    steps = reduce(Column.__add__, [F.lit(1.0) / (n + i) for i in range(10)])
    return F.log(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - steps


def _ball_sums(cells: DataFrame, k: int, block: int) -> DataFrame:
    """id and the sum of digamma(class values in the ball) - digamma(all values in the ball), over (id, label, x, c), c being how
    often the value stands; classes of one value are left out before."""
    place = positions(cells, [F.col("id"), F.col("label"), F.col("x")])
    starts = place.groupBy(F.col("id").alias("_i"), F.col("label").alias("_l")).agg(F.min("_place").alias("_start"))
    same = (F.col("id") == F.col("_i")) & (F.col("label") == F.col("_l"))
    place = place.join(starts, same).withColumn("_rank", F.col("_place") - F.col("_start"))
    everywhere = cut(cells.groupBy(F.col("id").alias("_i"), F.col("x").alias("_x")).agg(F.sum("c").alias("_m")))
    own = F.floor(F.col("_rank") / block)
    blocks = F.array_distinct(F.array(F.floor((F.col("_rank") - k) / block), own, F.floor((F.col("_rank") + k) / block)))
    dealt = place.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("id", "label", "_block").orderBy("_rank")
    # Distances to the k values before and after, each as often as the value stands, and to the equal ones.
    beside = [(F.abs(f("x", j).over(w) - F.col("x")), f("c", j).over(w)) for j in range(1, k + 1) for f in (F.lag, F.lead)]
    near = F.array_sort(F.filter(F.array(*[F.struct(d.alias("d"), n.alias("n")) for d, n in beside]), lambda s: s["d"].isNotNull()))
    wanted = F.least(F.lit(k), F.col("size") - 1)
    reached = F.aggregate(
        "_near",
        F.struct((F.col("c") - 1).cast("long").alias("seen"), F.lit(0.0).alias("r")),
        lambda at, s: F.struct((at["seen"] + s["n"]).alias("seen"), F.when(at["seen"] >= wanted, at["r"]).otherwise(s["d"]).alias("r")),
    )
    balls = dealt.withColumn("_near", near).where(F.col("_block") == F.col("_own")).withColumn("r", reached["r"]).select("id", "_place", "x", "c", "r", wanted.alias("k"))
    balls = cut(balls)
    tied = balls.where("r = 0").join(everywhere, (F.col("id") == F.col("_i")) & (F.col("x") == F.col("_x")))
    tied = tied.select("id", (F.col("c") * (digamma(F.col("c")) - digamma(F.col("_m")))).alias("s"))

    points = everywhere.select(F.col("_i").alias("id"), F.col("_x").alias("v"), F.lit(1).alias("kind"), F.col("_m").alias("w"), F.lit(None).cast("long").alias("ball"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("k"))
    # A ball's upper end stands before equal values, its lower end behind them.
    ends = F.inline(F.array(*[F.struct(v.alias("v"), F.lit(kind).alias("kind")) for v, kind in ((F.col("x") + F.col("r"), 0), (F.col("x") - F.col("r"), 2))]))
    ends = balls.where("r > 0").select("id", "c", "k", F.col("_place").alias("ball"), ends).select("id", "v", "kind", F.lit(0).cast("long").alias("w"), "ball", "c", "k")
    ordered = cut(points.unionByName(ends).orderBy("id", "v", "kind").withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    sums = ordered.groupBy(F.col("_part").alias("_p")).agg(F.sum("w").alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_p", before.alias("_before"))  # one row for each range
    run = ordered.withColumn("_run", F.sum("w").over(Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = run.where("ball is not null").join(F.broadcast(sums), F.col("_part") == F.col("_p"))
    counted = counted.groupBy("id", "ball", "c", "k").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1) * (F.col("_run") + F.col("_before"))).alias("_m"))
    open_ = counted.select("id", (F.col("c") * (digamma(F.col("k")) - digamma(F.greatest("_m", F.lit(1))))).alias("s"))
    return tied.unionByName(open_).groupBy("id").agg(F.sum("s").alias("s"))


def _estimated(cells: DataFrame, k: int, block: int) -> DataFrame:
    """id, mi of cells (id, label, x), neither null; without any class of two values there is no estimate."""
    counted = cells.groupBy("id", "label", "x").agg(F.count(F.lit(1)).alias("c"))
    sizes = cut(counted.groupBy(F.col("id").alias("_i"), F.col("label").alias("_l")).agg(F.sum("c").alias("size")).where("size > 1"))
    kept = cut(counted.join(sizes, (F.col("id") == F.col("_i")) & (F.col("label") == F.col("_l"))).drop("_i", "_l"))
    n = F.sum("size")
    whole = sizes.groupBy("_i").agg(n.alias("_n"), (digamma(n) - F.sum(F.col("size") * digamma(F.col("size"))) / n).alias("_h"))
    return _ball_sums(kept, k, block).join(whole, F.col("id") == F.col("_i")).select("id", F.greatest(F.col("_h") + F.col("s") / F.col("_n"), F.lit(0.0)).alias("mi"))


def neighbour_information(df: DataFrame, target: str, features: list[str] | None = None, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """feature, mi. Of a numeric and another column it is estimated from nearest neighbours, of two columns that are not numeric from
    counts, of two numeric ones from counts in bins.

    A missing number stands for the median of its column, a missing class of the target for the most frequent one (the least of
    these), other missing classes are a class of their own. Equal rows count as often as they stand. Infinite values count as the
    least or greatest number. A numeric column without values has no row, nor has any where no class has two values.
    """
    names = [c for c in (features or E.comparable_columns(df)) if c != target]
    numbers = set(E.numeric_columns(df))
    plain = [c for c in names if (c in numbers) == (target in numbers)]
    mixed = [c for c in names if c not in plain]
    made = []
    if plain:
        made.append(importance.mutual_information(df, target, plain))
    if mixed:
        most = 1.7976931348623157e308
        wanted = [target] if target in numbers else mixed
        middle = {c: v[0] for c, v in order_statistics(df, wanted, (0.5,)).items()}
        filled = lambda c: F.coalesce(E.number(c), F.lit(middle.get(c)).cast("double"))
        number = lambda c: F.when(filled(c).isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), filled(c))) + F.lit(0.0))
        frequent = df.where(E.q(target).isNotNull()).groupBy(E.q(target).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "v").first() if target not in numbers else None
        classes = lambda c: F.coalesce(E.q(c).cast("string"), F.lit(frequent.v if frequent else "nan") if c == target else F.lit("nan"))
        cells = [F.struct(F.lit(i).alias("id"), (classes(c) if target in numbers else classes(target)).alias("label"), (number(target) if target in numbers else number(c)).alias("x")) for i, c in enumerate(mixed)]
        found = _estimated(df.select(F.inline(F.array(*cells))).where("x is not null"), k, block)
        made.append(found.select(F.element_at(F.array(*map(F.lit, mixed)), F.col("id") + 1).alias("feature"), "mi"))
    return reduce(DataFrame.unionByName, made) if made else df.sparkSession.createDataFrame([], T.StructType().add("feature", "string").add("mi", "double"))
