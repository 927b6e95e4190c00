"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is a share of the words of all sources, by weight, held under ``max_repeats`` times what the source has;
what is held back goes to the others by weight until no target is above. Inside a source a document's expected copies grow
with its length class (the bit length of its word count), so inclusion is unequal: ``copies = min(max_repeats, c * class)``
with c such that the expected words meet the target. Whole copies are certain. What is left of the expectation is the
inclusion odds of one more copy: documents are ranked by ``odds(u) / odds(inclusion)``, u a hash of the document, and the
first ones whose words fill the rest of the target get it.

No step gathers a source in one task. Sums run over (source, class), then over about sqrt(n) rank buckets per source, then
inside the one bucket in which the target is reached, which again has about sqrt(n) documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.llm.common import WORD, materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 77
BROADCAST_ROWS = 20_000
"""Rows of (source, class) up to which the plan of the sources is broadcast; beyond, it is joined by shuffle."""


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """(_source, source_size, target) from one row per source (_source, source_size), weights dealt in code-point order,
    null last. Sources reach their cap in order of cap to weight; the level at which the others stand follows from sums."""
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    slot = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (slot + 1).cast("int")))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.col("_source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = F.least(F.lit(share), F.lit(float(most))) * F.sum("source_size").over(everything)
    return (
        weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_level", (wanted - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
        .withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
        .withColumn("_last", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.col("_source"), F.col("_level").alias("level")))).over(everything)["level"])
        .select("_source", "source_size", F.when(F.col("_open"), F.col("_last") * F.col("_w")).otherwise(F.col("_cap")).alias("target"))
    )


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MAX_REPEATS,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row with size, source_size, target, copies and taken (= copies * size); ``keep`` names the columns that go
    along (the id, if None).

    A null text has size 0; documents of size 0 are never taken. A null source is a source of its own. Repeated rows are
    documents of their own; rows equal in id, text and all columns to keep draw the same number, so which of them is taken
    cannot be told apart. A null id draws like any other value. Very long texts count whole. An empty table gives no rows.
    Columns to keep travel under names of their own, so theirs can't clash.
    """
    keep = keep or [id_col]
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    hashable = lambda c: not any(kind in docs.schema[c].dataType.simpleString() for kind in ("map<", "variant"))
    more = [F.col(c) for c in keep if c not in (id_col, text_col) and hashable(c)]
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), *more)
    base = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(source_col).cast("string").alias("_source"), size.alias("size"), draw.alias("_draw"))
    base = materialize(base.withColumn("_class", F.when(F.col("size") > 0, F.length(F.bin("size")))), "mix-sizes")
    classes = materialize(base.groupBy("_source", "_class").agg(F.sum("size").alias("_words"), F.count("*").alias("_docs")), "mix-classes")
    few = F.broadcast if classes.count() <= BROADCAST_ROWS else lambda df: df
    goal = targets(classes.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, most)

    # c: classes of a source reach the cap in order of class, largest first.
    by_class = Window.partitionBy("_source").orderBy(F.col("_class").desc())
    full = F.coalesce(F.sum("_words").over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("_words") * F.col("_class")).over(by_class.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    goal = goal.withColumnRenamed("_source", "_goal_source")
    plan = classes.where("_class is not null").join(goal, _same(F.col("_source"), F.col("_goal_source"))).drop("_goal_source")
    plan = plan.withColumn("_c", (F.col("target") - full) / rest).withColumn("_open", F.col("_c") * F.col("_class") < most)
    plan = plan.withColumn("_c", F.max(F.when(F.col("_open"), F.struct("_class", "_c"))).over(Window.partitionBy("_source"))["_c"])
    plan = (
        plan.withColumn("_expect", F.when(F.col("_open"), F.col("_c") * F.col("_class")).otherwise(F.lit(float(most))))
        .withColumn("_whole", F.floor("_expect").cast("long"))
        .withColumn("_odds", F.col("_expect") - F.col("_whole"))
    )
    of_source = Window.partitionBy("_source")
    plan = plan.withColumn("_left", F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(of_source)).withColumn("_ratio", F.when(F.col("_odds") > 0, F.col("_odds") / (1 - F.col("_odds"))))
    ranked_docs = F.sum(F.when(F.col("_odds") > 0, F.col("_docs"))).over(of_source)
    share = F.when(F.col("_odds") > 0, F.struct((F.col("_docs") / ranked_docs).alias("p"), F.col("_ratio").alias("r")))
    plan = plan.withColumn("_buckets", F.ceil(F.sqrt(ranked_docs))).withColumn("_shares", F.collect_list(share).over(of_source))  # one entry a class
    plan = plan.select(F.col("_source").alias("_ps"), F.col("_class").alias("_pc"), "_whole", "_ratio", "_left", "_buckets", "_shares")

    # The Pareto key odds(u) / odds(inclusion); its distribution in the source is known from the classes, so buckets of equal
    # probability hold about equally many documents.
    u = (F.pmod(F.col("_draw"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    below = F.aggregate("_shares", F.lit(0.0), lambda total, x: total + x["p"] * (F.col("_key") * x["r"] / (1 + F.col("_key") * x["r"])))
    ranked = (
        base.join(few(plan), _same(F.col("_source"), F.col("_ps")) & (F.col("_class") == F.col("_pc")), "left")
        .withColumn("_key", u / (1 - u) / F.col("_ratio"))
        .withColumn("_bucket", F.when(F.col("_key").isNotNull(), F.least(F.floor(below * F.col("_buckets")), F.col("_buckets") - 1)))
        .drop("_ps", "_pc", "_buckets", "_ratio", "_shares")
    )
    ranked = materialize(ranked, "mix-ranked")
    sums = ranked.where("_bucket is not null").groupBy("_source", "_bucket").agg(F.sum("size").alias("_in"), F.first("_left").alias("_left"))
    sums = sums.withColumn("_upto", F.sum("_in").over(Window.partitionBy("_source").orderBy("_bucket")))
    edge = (
        sums.where(F.col("_upto") >= F.col("_left"))
        .groupBy("_source")
        .agg(F.min(F.struct("_bucket", (F.col("_left") - F.col("_upto") + F.col("_in")).alias("_room"))).alias("_e"))
        .select(F.col("_source").alias("_es"), F.col("_e._bucket").alias("_edge"), F.col("_e._room").alias("_room"))
    )
    ranked = ranked.join(few(edge), _same(F.col("_source"), F.col("_es")), "left").drop("_es")
    inside = F.col("_bucket") == F.col("_edge")
    at_edge = ranked.where(inside)
    order = Window.partitionBy("_source").orderBy("_key", "_draw", "size")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at_edge = at_edge.withColumn("_extra", (F.col("_room") - F.coalesce(run, F.lit(0)) >= F.col("size") / 2.0).cast("long"))
    # Beyond the edge nothing is taken; where the target is never reached, all ranked documents are.
    others = ranked.where(~F.coalesce(inside, F.lit(False)))
    others = others.withColumn("_extra", F.when(F.col("_bucket").isNotNull() & (F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge"))), 1).otherwise(0).cast("long"))
    copies = F.coalesce(F.col("_whole"), F.lit(0)) + F.col("_extra")
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    done = at_edge.unionByName(others)
    return done.join(few(goal), _same(F.col("_source"), F.col("_goal_source"))).select(
        *kept, "size", "source_size", F.col("target").cast(T.DoubleType()).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: words taken from every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
