"""Exact order statistics of many columns by distributed selection: count, narrow, count.

Each pass counts the cells of all columns in buckets, which combine within tasks, and keeps of every wanted rank the bucket that holds it,
as the least and the greatest value in it. The first pass cuts by sign and eighths of powers of two, so values of any size spread;
further ones cut what is left evenly, and as soon as a bucket has few cells, value by value. A bucket of one value is an answer. State is a
fixed number of buckets for each column and wanted rank, whatever the number of rows and of distinct values, and the driver gets
one row for each wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions import exprs as E

EVEN = 8192
"""Buckets of one bracket in a pass after the first."""
FEW = 50_000
"""Cells of a bracket that the next pass counts value by value."""
AT_ONCE = 400
"""Cells of a row that one pass looks at; more columns and brackets are taken in groups."""


def _first_bucket(x: Column) -> Column:
    """A number that never falls as x grows: sign and eighths of powers of two."""
    size = F.when(F.abs(x) == float("inf"), F.lit(50_000.0)).otherwise(F.floor(F.log2(F.abs(x)) * 8).cast("double") + 10_000.0)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size)


def _picked(cells: DataFrame, ranks: dict[int, list[int]] | None, fractions: tuple[float, ...]) -> list:
    """Of cells (id, bucket, x): for each wanted rank of an id the bucket that it falls in, with the cells before it. Without ranks those
    around the fractions of each id's cells are wanted."""
    of = Window.partitionBy("id")
    counted = cells.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    counted = counted.withColumn("upto", F.sum("n").over(of.orderBy("bucket"))).withColumn("total", F.sum("n").over(of))
    if ranks is None:
        at = [F.lit(p) * (F.col("total") - 1) for p in fractions]
        wanted = F.array_distinct(F.array(*[c for a in at for c in (F.floor(a), F.ceil(a))]))
    else:
        pairs = sorted(ranks.items())
        wanted = F.element_at(F.create_map(*[x for i, r in pairs for x in (F.lit(i), F.array(*map(F.lit, r)).cast("array<bigint>"))]), F.col("id"))
    inside = F.filter(wanted, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    return counted.withColumn("rank", F.explode(inside)).select("id", "rank", (F.col("upto") - F.col("n")).alias("before"), "n", "lo", "hi", "total").collect()


def _cells(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    """(id, x) of the cells that are not null. Nothing else is worked out beside a row's other cells: the code for a row would pass the
    size up to which the JVM compiles it."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("id"), E.number(c).alias("x")) for i, c in columns.items()]))).where("x is not null")


def _bracketed(df: DataFrame, columns: dict[int, str], brackets: list[tuple[int, int, float, float, int]]) -> DataFrame:
    """(id, x, bucket) of the cells that fall in brackets (id, column, least, greatest, cells in it), which are broadcast."""
    rows = df.sparkSession.createDataFrame([(at, i, lo, hi, n <= FEW) for i, at, lo, hi, n in brackets], "_at int, _bracket int, _lo double, _hi double, _few boolean")
    x, lo, hi = F.col("x"), F.col("_lo"), F.col("_hi")
    inside = _cells(df, columns).join(F.broadcast(rows), (F.col("id") == F.col("_at")) & x.between(lo, hi))
    even = F.floor((x - lo) / (hi - lo) * EVEN).cast("double")
    return inside.select(F.col("_bracket").alias("id"), "x", F.when(F.col("_few"), x).otherwise(even).alias("bucket"))


def order_statistics(df: DataFrame, columns: list[str], fractions: tuple[float, ...] = E.QUARTILES) -> dict[str, list[float]]:
    """For each numeric column that has values its quantiles at the fractions, with linear interpolation between neighbours. Nulls and
    NaN don't count."""
    found: dict[str, list[float]] = {}
    for i in range(0, len(columns), AT_ONCE):
        found |= _selected(df, columns[i : i + AT_ONCE], fractions)
    return found


def _selected(df: DataFrame, columns: list[str], fractions: tuple[float, ...]) -> dict[str, list[float]]:
    values: dict[tuple[int, int], float] = {}
    totals: dict[int, int] = {}
    open_: list[tuple[int, float, float, int, list[int]]] = []  # column, bracket, cells in it, ranks in the column

    def take(rows, column: dict[int, int], shift: dict[int, int]) -> None:
        brackets: dict[tuple, list] = {}
        for r in rows:
            at = column[r.id]
            totals.setdefault(at, r.total)
            if r.lo == r.hi:
                values[at, shift[r.id] + r["rank"]] = r.lo
            else:
                brackets.setdefault((at, r.lo, r.hi, r.n, shift[r.id] + r.before), []).append(shift[r.id] + r["rank"])
        open_.extend((*key, ranks) for key, ranks in brackets.items())

    names = dict(enumerate(columns))
    take(_picked(_cells(df, names).withColumn("bucket", _first_bucket(F.col("x"))), None, fractions), {i: i for i in names}, dict.fromkeys(names, 0))
    while open_:
        now, open_ = open_[:AT_ONCE], open_[AT_ONCE:]
        brackets = [(i, at, lo, hi, n) for i, (at, lo, hi, n, _, _) in enumerate(now)]
        ranks = {i: [r - before for r in wanted] for i, (_, _, _, _, before, wanted) in enumerate(now)}
        read = {at: names[at] for at in sorted({b[0] for b in now})}
        take(_picked(_bracketed(df, read, brackets), ranks, fractions), {i: b[0] for i, b in enumerate(now)}, {i: b[4] for i, b in enumerate(now)})

    def at_fraction(column: int, p: float) -> float:
        place = p * (totals[column] - 1)
        low = int(place)
        a = values[column, low]
        b = values[column, low + (place > low)]
        return a if a == b else a + (b - a) * (place - low)

    return {columns[i]: [at_fraction(i, p) for p in fractions] for i in sorted(totals)}
